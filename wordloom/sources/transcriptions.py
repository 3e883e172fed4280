"""Transcriptions by id from any address that urllib opens, as a Spark data source: fetched by the tasks, not the driver."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tei import parse_transcriptions


class Share(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class TranscriptionReader(DataSourceReader):
    def __init__(self, options: dict):
        if "{id}" not in options.get("template", ""):
            raise ValueError("the option template must hold {id}")
        self.template, self.absent = options["template"], options.get("absent", "")
        self.ids = [x.strip() for x in options.get("ids", "").split(",") if x.strip()]
        self.timeout, self.pause = float(options.get("timeout", 350)), float(options.get("pause", 0))
        self.each = max(1, int(options.get("idsPerTask", 16)))

    def partitions(self) -> list[Share]:
        return [Share(self.ids[i : i + self.each]) for i in range(0, len(self.ids), self.each)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for i in partition.ids:
            try:
                with urlopen(self.template.replace("{id}", quote(i)), timeout=self.timeout) as answer:
                    status, body = answer.status or 200, answer.read().decode("utf-8")
            except (OSError, ValueError) as e:  # unreachable, refused, not found, not UTF-8
                yield i, None, f"{type(e).__name__}: {e}"
                continue
            if status == 200 and self.absent and self.absent in body:
                yield i, None, "no transcription"
                continue
            yield (i, body, None) if status == 200 else (i, None, f"status {status}")
            time.sleep(self.pause)


class TranscriptionSource(DataSource):
    """Options: ids (comma-separated), template (an address with {id}), absent (a text that tells of no transcription), timeout
    and pause in seconds, idsPerTask. Rows: ms_id, xml (null where there is none), error (why)."""

    @classmethod
    def name(cls) -> str:
        return "transcriptions"

    def schema(self) -> str:
        return "ms_id string, xml string, error string"

    def reader(self, schema) -> TranscriptionReader:
        return TranscriptionReader(self.options)


def fetch(spark: SparkSession, ids: list[str], template: str, **options) -> DataFrame:
    """ms_id, xml, error of each id. Failures are rows too; `where("error is null")` keeps the successes with their ids."""
    spark.dataSource.register(TranscriptionSource)
    return spark.read.format("transcriptions").options(ids=",".join(ids), template=template, **options).load()


def extract(spark: SparkSession, ids: list[str], template: str, out: str, book_id: str = "B20", block: int = 64, fetch_options: dict | None = None) -> DataFrame:
    """ms_id, title, pos, chapter, verse, text of all manuscripts under out, after the missing ones of ids were fetched, parsed and added.

    Each block of ids is one job that appends to out/verses: a run that ends early keeps its whole blocks, and the next run fetches
    what out lacks and nothing twice. A manuscript without verses is one row with nulls, so it is not fetched again; what could not be
    fetched or parsed is logged in out/failures, with its id, and tried again.
    """
    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "ms_id string")
    have = extracted(spark, out)
    missing = [r["ms_id"] for r in (wanted if have is None else wanted.join(have.select("ms_id").distinct(), "ms_id", "left_anti")).collect()]  # no more than were asked for
    order = {i: n for n, i in enumerate(dict.fromkeys(ids))}
    missing.sort(key=order.__getitem__)
    for at in range(0, len(missing), block):
        got = parse_transcriptions(fetch(spark, missing[at : at + block], template, **(fetch_options or {})), book_id=book_id).persist()
        failed = got.select("ms_id", F.coalesce("error", "parsed.error").alias("error")).where("error is not null")
        failed.write.mode("append").json(f"{out}/failures")
        good = got.where("error is null and parsed.error is null")
        good.select("ms_id", "parsed.title", F.posexplode_outer("parsed.verses").alias("pos", "v")).select("ms_id", "title", "pos", "v.*").write.mode("append").parquet(f"{out}/verses")
        got.unpersist()
    return extracted(spark, out) or spark.createDataFrame([], VERSES)


VERSES = "ms_id string, title string, pos int, chapter string, verse string, text string"


def extracted(spark: SparkSession, out: str) -> DataFrame | None:
    """What extract has written so far; None before the first block."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/verses")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(VERSES).parquet(f"{out}/verses")


def as_corpus(verses: DataFrame) -> DataFrame:
    """Extracted verses as a corpus for write_nested: the book is the manuscript."""
    return verses.where("chapter is not null").select(F.col("ms_id").alias("book"), "chapter", "verse", "text", "pos")
