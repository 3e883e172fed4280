"""Noisy copies of test sets at all levels of a language, by errors learned from OCR pairs.

    spark-submit -m wordloom.plans.noise_levels --data folder --out folder

For each language the folder holds {language}.json (the test set) and {language}_pairs (X.txt beside X_gt.txt).
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, noise
from ..sources import corpus

#: The ending of OCR file names of each language; all but lat take the Greek alphabet.
SUFFIXES = {"greek": "v", "lat": "r", "seals": "v"}


def corrupt_language(spark: SparkSession, language: str, test_set: str, pairs_folder: str, out: str) -> DataFrame | None:
    """book, chapter, verse, text, pos, level: also written to out/noisy, the tables learned to out/distributions.

    None with a warning where the test set, the folder or pairs in it are missing.
    """
    alphabet, table = (text.LATIN_ALPHABET, {text.GAP: ""}) if language == "lat" else (text.GREEK_ALPHABET, text.greek_fold())
    try:
        verses = corpus.read_nested(spark, test_set)
        pairs = corpus.read_ocr_pairs(spark, pairs_folder, SUFFIXES[language], alphabet, table)
    except AnalysisException as e:
        warnings.warn(f"{language} is skipped: {e.getCondition()}", stacklevel=2)
        return None
    if not pairs.take(1):
        warnings.warn(f"{language} is skipped: no pairs", stacklevel=2)
        return None
    tables = noise.learn(align.align_pairs(pairs, [])).persist()
    corpus.write_distributions(tables, f"{out}/distributions")
    noisy = noise.corrupt_levels(verses, tables, corpus.NOISE_LEVELS[language], F.concat_ws("|", "book", "chapter", "verse"), alphabet, table)
    noisy.write.mode("overwrite").partitionBy("level").parquet(f"{out}/noisy")
    tables.unpersist()
    return spark.read.parquet(f"{out}/noisy")


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    a = p.parse_args()
    spark = SparkSession.builder.appName("noise-levels").getOrCreate()
    for language in corpus.NOISE_LEVELS:
        corrupt_language(spark, language, f"{a.data}/{language}.json", f"{a.data}/{language}_pairs", f"{a.out}/{language}")


if __name__ == "__main__":
    main()
