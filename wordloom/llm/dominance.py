"""Dominance counting by the logarithmic method, over shards that scanned histograms seed.

Rows are points (slot, level). In the order "slot ascending, level descending" whatever is above a row, that is has a slot no larger
and a level strictly larger, stands before it, and of what stands before it exactly the rows with a larger level are above. So any
cut of that order into shards works, also through one slot or one point. A shard's stream keeps runs sorted by level, with sums of
weights from each place to the end; a new run is merged with one of its size, then with one of twice that size, and so on, and a
row's count is found in each run by binary search.

What earlier shards hold above a row comes in two parts. Levels are cut into bands: frequent levels are bands of their own, the others
lie between them. A table of rows and weights by shard and band, summed over earlier shards and higher bands, seeds each shard's
stream. Rows of the row's own band, if it holds more than one level, come from a second stream in the order "band, shard, level
ascending", in which again exactly the earlier rows with a larger level count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from .common import Workspace

#: Shards and level edges for each shuffle partition, sampled rows for each of them, rows of the smallest run.
SHARDS, SAMPLED, RUN = 2, 32, 512
#: Numbers beyond this are no levels: they don't fit a long.
LARGEST = 9.2e18
RESULTS = {"slot", "level", "n_sales", "n_rows"}


class Runs:
    """A stream of (level, weight): how many earlier ones have a strictly larger level, and the sum of their weights."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _run(level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(level, kind="stable")
        # sums of the weights from each place to the end, 0 behind it
        sums = np.append(np.cumsum(weight[order][::-1])[::-1], 0)
        return level[order], weight[order], sums

    def above(self, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, weights = np.zeros(len(level), np.int64), np.zeros(len(level), np.int64)
        for levels, _, sums in self.runs:
            at = np.searchsorted(levels, level, "right")
            rows += len(levels) - at
            weights += sums[at]
        return rows, weights

    def insert(self, level: np.ndarray, weight: np.ndarray) -> None:
        while self.runs and len(self.runs[-1][0]) <= len(level):
            levels, weights, _ = self.runs.pop()
            level, weight = np.concatenate([levels, level]), np.concatenate([weights, weight])
        self.runs.append(self._run(level, weight))

    def pass_through(self, level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts for a piece of the stream, whose rows also count for one another, and then its insertion."""
        rows, weights = np.zeros(len(level), np.int64), np.zeros(len(level), np.int64)
        for lo in range(0, len(level), RUN):
            x, w = level[lo : lo + RUN], weight[lo : lo + RUN]
            n, s = self.above(x)
            higher = np.tri(len(x), k=-1, dtype=bool) & (x[None, :] > x[:, None])
            rows[lo : lo + RUN], weights[lo : lo + RUN] = n + higher.sum(axis=1), s + higher @ w
            self.insert(x, w)
        return rows, weights


def _streamed(group: str, seeded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches sorted by `group` and a stream's order: adds what stands earlier in the group, and the seed, to n and w.

    Seeded groups begin with rows without a weight: a band with what earlier shards hold above it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, seeds = None, Runs(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(group).to_numpy()
            starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for lo, hi in zip(starts, starts[1:]):
                piece = batch.slice(lo, hi - lo)
                if now != of[lo]:
                    now, runs, seeds = of[lo], Runs(), {}
                n, w = piece.column("n").to_numpy(), piece.column("w").to_numpy()
                band = piece.column("band").to_numpy()
                if seeded:
                    real = piece.column("weight").is_valid().to_numpy(zero_copy_only=False)
                    seeds |= dict(zip(band[~real].tolist(), zip(n[~real].tolist(), w[~real].tolist())))
                    piece, band, n, w = piece.filter(pa.array(real)), band[real], n[real], w[real]
                    if not piece.num_rows:
                        continue
                    kinds, at = np.unique(band, return_inverse=True)
                    given = np.array([seeds.get(b, (0, 0)) for b in kinds.tolist()], np.int64)[at]
                    n, w = n + given[:, 0], w + given[:, 1]
                rows, weights = runs.pass_through(piece.column("level").to_numpy(), piece.column("weight").to_numpy())
                out = {"n": pa.array(n + rows), "w": pa.array(w + weights)}
                yield pa.RecordBatch.from_arrays([out.get(name, piece.column(name)) for name in piece.schema.names], names=piece.schema.names)

    return run


def _first_places(edges: np.ndarray, slot: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For points the number of edges (slot, level) before them and of those not behind them, in the order of the stream."""
    lo, hi = np.searchsorted(edges[:, 0], slot, "left"), np.searchsorted(edges[:, 0], slot, "right")
    first, last = lo.copy(), hi.copy()
    for i, j in set(zip(lo[lo < hi].tolist(), hi[lo < hi].tolist())):  # slots that edges lie in
        at = (lo == i) & (hi == j)
        falling = edges[i:j, 1][::-1]
        first[at] = j - np.searchsorted(falling, level[at], "right")
        last[at] = j - np.searchsorted(falling, level[at], "left")
    return first, last


def _quantiles(ordered: np.ndarray, n: int) -> np.ndarray:
    return ordered[[len(ordered) * i // n for i in range(1, n)]] if len(ordered) else ordered


def count_above(df: DataFrame, work: Workspace, slot: Column, level: Column, weight: Column) -> DataFrame:
    """df plus slot, level, n_sales, n_rows: for each row the rows above it, each counted once and by its weight.

    slot, level and weight give longs. A row is above another if its slot is no larger and its level is strictly larger. A row
    whose slot or level is null is above none and its counts are null; a null weight counts 1. Repeated rows count each by itself.
    Columns of df with the names of the results are replaced; empty input gives an empty result.
    """
    kept = [c for c in df.columns if c.lower() not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(1).alias("none"))
    named = df.select(row.alias("row"), slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight, F.lit(1)).cast("long").alias("weight"))
    n = SHARDS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = named.where("slot is not null and level is not null").select("slot", "level")
    some = points.sample(min(1.0, SAMPLED * n / max(1, points.count())), seed=13).toPandas().to_numpy(np.int64).reshape(-1, 2)  # about SAMPLED * n rows
    edges = _quantiles(some[np.lexsort([-some[:, 1], some[:, 0]])], n)
    levels = np.unique(_quantiles(np.sort(some[:, 1]), n))
    schema = StructType([*[StructField(f.name, f.dataType) for f in named.schema.fields], *[StructField(c, LongType()) for c in ("shard", "band", "n", "w")]])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(29)
        for b in batches:
            void = pc.or_(pc.is_null(b.column("slot")), pc.is_null(b.column("level")))
            s, x = (b.column(c).fill_null(0).to_numpy() for c in ("slot", "level"))
            first, last = _first_places(edges, s, x)
            # a point that several edges share may go to any shard between them; level edges are the odd bands
            made = (rng.integers(first, last + 1), np.searchsorted(levels, x, "left") + np.searchsorted(levels, x, "right"))
            zero = pa.array(np.zeros(len(s), np.int64))
            marked = [pc.if_else(void, pa.scalar(None, pa.int64()), pa.array(m.astype(np.int64))) for m in made]
            yield pa.RecordBatch.from_arrays([*b.columns, *marked, zero, zero], names=schema.names)

    dealt = work.settle(named.mapInArrow(deal, schema), "dealt")
    placed = dealt.where("shard is not null")
    # the scanned histogram has a cell for each shard and band, a number that the input has no part in
    cells = placed.groupBy("shard", "band").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    frame = df.sparkSession.range(n).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * len(levels)).cast("long"))).alias("band"))
    before = lambda *by: Window.partitionBy(by[0]).orderBy(by[1]).rowsBetween(Window.unboundedPreceding, -1)
    scan = frame.join(cells, ["shard", "band"], "left")
    for w in (before("band", "shard"), before("shard", F.desc("band"))):
        scan = scan.select("shard", "band", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("n", "w")])
    seeds = work.settle(scan, "seeds").where("n > 0")
    streams = placed.unionByName(seeds, allowMissingColumns=True).repartitionByRange(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("slot"), F.desc("level"))
    counted = work.settle(streams.mapInArrow(_streamed("shard", True), schema), "counted")
    # even bands lie between edges and hold several levels: their rows meet those of earlier shards
    shared = F.col("band") % 2 == 0
    met = counted.where(shared).repartitionByRange(n, "band").sortWithinPartitions("band", "shard", "level").mapInArrow(_streamed("band", False), schema)
    nothing = F.lit(None).cast("long")
    whole = met.unionByName(counted.where(~shared)).unionByName(dealt.where("shard is null").withColumn("n", nothing).withColumn("w", nothing))
    return whole.select(*[F.col("row").getField(c).alias(c) for c in kept], "slot", "level", F.col("n").alias("n_sales"), F.col("w").alias("n_rows"))


def day_of(moment: str, df: DataFrame) -> Column:
    """Days since 1970 of a timestamp. One without a zone, like a date, is read as UTC whatever the session's zone."""
    c = F.col(f"`{moment}`")
    if isinstance(df.schema[moment].dataType, TimestampType):
        return F.floor(F.unix_seconds(c) / 86400)
    return F.unix_date(c.cast("date")).cast("long")


def level_of(total: Column) -> Column:
    """floor(floor(100 * total + 0.5) / 1000) in doubles; null for null and for what is no number or fits no long."""
    cents = 100 * total.cast("double") + 0.5
    whole = F.when(F.abs(cents) < 2.0**53, F.floor(cents).cast("double")).otherwise(cents) / 1000  # beyond, a double has no fraction
    return F.when(F.abs(whole) < LARGEST, F.floor(whole))


def repeats_of(key: Column) -> Column:
    """1 to 3, by the crc32 of the key in decimal digits; 1 for null."""
    return 1 + F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3
