"""Shared plumbing: the work folder, written tables, checked broadcasts and Arrow batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows of an Arrow batch that programs set; a batch of the longest documents must fit a Python worker.
BATCH_ROWS = 1000
#: Rows of ids and numbers that one task writes, where their number is known.
ROWS_PER_TASK = 20_000
#: Measured bytes up to which a table may be broadcast.
BROADCAST_BYTES = 8 << 20


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="wordloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may go without it; it then gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return base.rstrip("/")


class Workspace:
    """A folder for the written tables of one operator run. Tables, not lineage, are what later jobs read.

    Results are read from it lazily, so it stays until its owner calls clear(); tables that nothing reads any more go before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.dir}/{self.n:03d}-{name}"

    def settle(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df as Parquet and read it back: cuts the lineage, survives the loss of executors.

        With a bound on its rows, df is written by one task for every ROWS_PER_TASK of them where that is less than a shuffle has.
        Give it for aggregations only: a task that merges many partitions of a sort would hold all their buffers.
        """
        if rows is not None and (tasks := max(4, -(-rows // ROWS_PER_TASK))) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out.settled_at = path
        return out

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete settled tables that no later job reads."""
        for t in tables:
            if path := getattr(t, "settled_at", None):
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.dir)


def _width(c: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        size = F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 * (size + 1)
        return size * 8 + 16
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """About what the rows of df take in memory, by one aggregation."""
    row = functools.reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields], F.lit(32).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n")).first()["n"]


def maybe_broadcast(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint if the measured bytes are within the bound; beyond it Spark joins as it sees fit."""
    return F.broadcast(df) if measured_bytes(df) <= bound else df


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df bears."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def grouped_tables(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows with equal keys from a stream sorted by them, about `rows` rows at a time, and where each group begins."""

    def starts(t: pa.Table) -> np.ndarray:
        cols = [t.column(k).to_numpy() for k in keys]
        return np.append(0, np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            begin = starts(t)
            if begin[-1]:
                yield t.slice(0, begin[-1]), begin[:-1]
                held = t.slice(begin[-1]).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """For programs, not operators: lower the session's Arrow batches to `rows`, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
