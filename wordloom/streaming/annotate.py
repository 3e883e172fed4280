"""Annotation of arriving texts. All operators of one verse are narrow, so the batch code runs on streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import corpus


def annotate_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = "doc_id long, text string", scheme: str = "binary") -> StreamingQuery:
    """Annotate Parquet files as they arrive in folder; each file once, rows with their labels appended to out."""
    arriving: DataFrame = spark.readStream.schema(schema).parquet(folder)
    annotated = corpus.annotated_corpus(arriving, scheme)
    return annotated.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
