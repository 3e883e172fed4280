"""Hard negatives for anchors by inner product, on a vector-approximation file.

Rows are dealt to blocks of bounded bytes. A block keeps, beside the vectors, for each dimension the number of the cell that each
component lies in, in a byte. For an anchor a table gives for each dimension and cell the largest product of the anchor's component
with what the cell holds; a row's bound is the sum of what its cells say, and as all cells of a dimension are equally wide, its lower
bound lies a fixed amount below. Only rows whose bounds let them enter the wanted places are scored exactly: for positives those not
surely below the fifth best, for negatives those that may lie in the window of a positive and are not surely below its tenth best.
Anchors meet all blocks, in blocks of their own; what the blocks find is merged.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of vectors in a block, as doubles; anchors that meet a block in one task; cells of a dimension; anchors looked up together.
BLOCK_BYTES, ANCHORS, CELLS, TOGETHER = 8 << 20, 4096, 64, 16
LONG = 2**63 - 1


def usable(vector: str) -> Column:
    """Not null, and every component is a finite number, also when multiplied."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < 1e300, F.lit(False))), F.lit(False))


class Block:
    """Vectors in whole numbers, sorted by label, and their cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        vectors = vectors[order]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors.astype(np.int32 if self.largest < 2**31 else np.float64)
        if self.largest < 2**31:
            v = self.vectors.astype(np.int64)
            self.low, high = v.min(axis=0, initial=2**31), v.max(axis=0, initial=-(2**31))
            self.width = np.maximum(1, -(-(high - self.low + 1) // CELLS))
            self.cells = np.ascontiguousarray(((v - self.low) // self.width).T.astype(np.uint8))

    def exact(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers; those beyond a long count as its limit."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 2**62:
            return self.vectors[rows].astype(np.int64) @ anchor.astype(np.int64)
        q = [int(x) for x in anchor]
        return np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(v, q, strict=True)))) for v in self.vectors[rows].tolist()], np.int64)

    def bounds(self, anchors: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray] | None:
        """For some anchors the upper bounds of rows lo to hi (a line for each anchor), and how far the lower ones lie below.

        None if sums may leave a long; then all rows have to be scored.
        """
        most = self.largest + CELLS * int(self.width.max(initial=1)) if self.largest < 2**31 else 2**62
        if most * int(np.abs(anchors).max(initial=0)) * max(1, anchors.shape[1]) >= 2**61:
            return None
        q = anchors.astype(np.int64)
        upper = np.zeros((hi - lo, len(q)), np.int64)
        for cells, low, width, x in zip(self.cells, self.low, self.width, q.T):
            start = low + width * np.arange(CELLS)
            table = np.maximum(np.outer(start, x), np.outer(start + width - 1, x))
            upper += table[cells[lo:hi]]
        return upper.T, np.abs(q) @ (self.width - 1)

    def of_label(self, label) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def positives(self, anchors: np.ndarray, ids: np.ndarray, label, k: int):
        """For anchors of one label: each one's place, and ids and scores of its k best other rows of the label."""
        lo, hi = self.of_label(label)
        for at in range(0, len(anchors) if hi > lo else 0, TOGETHER):
            part = anchors[at : at + TOGETHER]
            bounds = self.bounds(part, lo, hi)
            for i, anchor in enumerate(part):
                rows = np.flatnonzero(self.ids[lo:hi] != ids[at + i])
                if bounds is not None and len(rows) > k:
                    upper = bounds[0][i][rows]
                    rows = rows[upper >= np.partition(upper, len(rows) - k)[len(rows) - k] - bounds[1][i]]
                yield at + i, *self._first(rows + lo, self.exact(rows + lo, anchor), k)

    def negatives(self, anchors: np.ndarray, windows: list[list[tuple[int, int]]], label, k: int):
        """For anchors of one label and each one's windows of scores: place, number of the window, ids and scores of its k best rows of other labels."""
        lo, hi = self.of_label(label)
        other = np.concatenate([np.arange(lo), np.arange(hi, len(self.ids))])
        for at in range(0, len(anchors) if len(other) else 0, TOGETHER):
            part = anchors[at : at + TOGETHER]
            bounds = self.bounds(part, 0, len(self.ids))
            for i, anchor in enumerate(part):
                rows = other
                if bounds is not None:
                    upper = bounds[0][i][other]
                    lower = upper - bounds[1][i]
                    may = np.zeros(len(other), bool)
                    for least, most in windows[at + i]:
                        sure = lower[(lower >= least) & (upper <= most)]
                        needed = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else least
                        may |= (upper >= needed) & (lower <= most)
                    rows = other[may]
                scores = self.exact(rows, anchor)
                for n, (least, most) in enumerate(windows[at + i]):
                    inside = (scores >= least) & (scores <= most)
                    yield at + i, n, *self._first(rows[inside], scores[inside], k)

    def _first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _whole(vectors, scale: int) -> np.ndarray:
    return np.floor(np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1) * scale)


def mine(
    df: DataFrame, work: Workspace, anchors: Column, label: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors is a condition on vec_id, label an expression over df. Components become floor(scale * x), scores are their inner products
    (one beyond a long counts as its limit). An anchor's positives are its first other rows of the same label, higher scores first, ties
    by smaller vec_id. For each of them the first rows of other labels with low * positive <= of * negative <= high * positive, where
    window is (low, high, of). Rows with a null vec_id, label or vector, a null or non-finite component or one of 1e300 or more take no
    part; only vectors of equal length meet. Other rows are those with another vec_id. Where rows share a vec_id, each counts as a
    positive and as a negative, so a pair may come twice, and as an anchor stands the one with the least label and vector. Without
    positives, or with no row in a window, there are no result rows. Other columns are left out; empty input gives an empty result.
    """
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).alias("embedding"))
    src = src.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")).withColumn("dim", F.size("embedding"))
    empty = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sizes = {r["dim"]: max(1, -(-r["n"] * max(1, r["dim"]) * 8 // BLOCK_BYTES)) for r in src.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length
    if not sizes:
        return empty
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    dealt = src.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), blocks).cast("int"))

    def approximate(key, pdf):
        block = Block(pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), _whole(pdf["embedding"], scale))
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "file": [pickle.dumps(block)]})

    files = work.settle(dealt.groupBy("dim", "block").applyInPandas(approximate, "dim int, block int, file binary"), "approximations")
    asked = src.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a")).select(F.col("vec_id").alias("anchor_id"), "a.label", "a.embedding", F.size("a.embedding").alias("dim"))
    asked = work.settle(asked, "anchors")
    parts = -(-asked.count() // ANCHORS) or 1
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).cast("int").alias("part")
    filed = files.select("dim", "block", "file", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).groupBy("dim", "block", "part")
    meet = lambda a: filed.cogroup(a.select("*", part, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).groupBy("dim", "block", "part"))

    def best(key, file, ask):
        out = []
        if len(file) and len(ask):
            block = pickle.loads(file["file"].iloc[0])
            for of, same in ask.groupby("label"):
                ids, vectors = same["anchor_id"].to_numpy(), _whole(same["embedding"], scale)
                out += [pd.DataFrame({"anchor_id": ids[i], "vec_id": found, "score": scores}) for i, found, scores in block.positives(vectors, ids, of, positives)]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("anchor_id", "vec_id", "score")})

    near = meet(asked).applyInPandas(best, "anchor_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = work.settle(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives), "positives")
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "score"))).alias("near"))  # as many as positives
    low, high, of_ = window

    def inside(key, file, ask):
        out = []
        if len(file) and len(ask):
            block = pickle.loads(file["file"].iloc[0])
            for label_, same in ask.groupby("label"):
                ids, vectors = same["anchor_id"].to_numpy(), _whole(same["embedding"], scale)
                scores = [[int(p["score"]) for p in near_] for near_ in same["near"]]
                spans = [[(-(-low * s // of_), high * s // of_) for s in line] for line in scores]
                out += [pd.DataFrame({"anchor_id": ids[i], "n": n + 1, "negative_id": found, "negative_score": got}) for i, n, found, got in block.negatives(vectors, spans, label_, negatives)]
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("anchor_id", "n", "negative_id", "negative_score")})

    hard = meet(asked.join(windows, "anchor_id")).applyInPandas(inside, "anchor_id long, n int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "n").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = hard.join(near.select("anchor_id", "n", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "n"])
    return named.select(*empty.columns)
