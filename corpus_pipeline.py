"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, PII, best-fit packing. Stages are in wordloom.llm.pipeline."""

from wordloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
