"""Annotated training lines of all corpora in both schemes.

    spark-submit --py-files wordloom.zip -m wordloom.plans.annotation --data corpora --out annotated
"""

from __future__ import annotations

import argparse
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..sources import corpus


def annotate_corpora(spark: SparkSession, data: str, out: str, corpora: dict[str, str] | None = None) -> DataFrame:
    """language, scheme, n_lines, n_unequal: data/<corpus>.json of each language, annotated to out/<corpus>-<scheme>.

    n_unequal lines have a text and labels of different lengths; they are written like all others. A corpus that is missing is left out
    with a warning.
    """
    rows = []
    for language, name in (corpora or corpus.CORPORA).items():
        try:
            verses = corpus.read_nested_split(spark, f"{data}/{name}.json").drop("pos").persist()
        except AnalysisException as e:
            warnings.warn(f"{language} is skipped: {e.getCondition()}", stacklevel=2)
            continue
        for scheme in labels.SCHEMES:
            lines = corpus.annotated_corpus(verses, scheme)
            corpus.write_annotated(lines, f"{out}/{name}-{scheme}")
            counts = lines.agg(F.count("*").alias("n"), F.count_if(~F.col("same_length")).alias("u")).first()
            rows.append((language, scheme, counts["n"], counts["u"]))
        verses.unpersist()
    return spark.createDataFrame(rows, "language string, scheme string, n_lines long, n_unequal long")


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    a = p.parse_args()
    annotate_corpora(SparkSession.builder.appName("annotation").getOrCreate(), a.data, a.out).show()


if __name__ == "__main__":
    main()
