"""Near-duplicate documents by MinHash: universal hash minima, banding, verification and connected components.

Every distinct shingle set gets HASHES minima of multiply-add-shift hash functions (Dietzfelbinger) and BANDS band keys.
Two sets of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS; at 0.8 they miss each other once in 2,500,000, and
the cut on agreeing minima drops less than one pair in 10^8 more. Within a band all members are compared with the least one
first, which joins groups of copies of any size in linear work; components of those links show which bands still hold members
of several components. Only there members of different components are compared, by signature and in blocks, each pair in the
first band it shares; the largest component of a band meets only the others. Links are confirmed on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from .common import Workspace, grouped_tables, maybe_broadcast, texts
from .components import connected_components

ROWS, BANDS = 4, 28
HASHES = ROWS * BANDS
#: Pairs whose signatures agree in fewer minima are not looked at again: 7 standard deviations under a similarity of 0.8.
LEAST_AGREEING = 60 / HASHES
#: Documents and shingles of a block, about; a group of rows that is compared holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
REMEMBERED = 400_000

U64 = np.uint64


@functools.cache
def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(0, 2**64, HASHES, dtype=np.uint64) | U64(1)
    return a, rng.integers(0, 2**64, HASHES, dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: bytes, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1) if len(h) else 0
    x = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        x = mix(x * U64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """Minima of all hash functions over a non-empty set."""
    a, b = hash_functions()
    low = x >> U64(32)
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for k in range(0, len(low), 4096):
        out = np.minimum(out, ((a[:, None] * low[None, k : k + 4096] + b[:, None]) >> U64(32)).min(axis=1))
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(BANDS, ROWS).astype(np.uint64)
    x = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        x = mix(x * U64(0x9E3779B97F4A7C15) + s[:, k])
    return x.view(np.int64)


def sketch(df: DataFrame, size: int, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes, null for empty sets), sig of each row, and the columns to carry."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    names = ["doc_id", "n_shingles", "set_key", "sig", *carry]
    schema = StructType.fromDDL("doc_id long, n_shingles long, set_key binary, sig binary")
    for c in carry:
        schema = schema.add(c, src.schema[c].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, key, sig = [], [], []
            for t in texts(batch.column(1)):
                x = shingles(t, size, known)
                n.append(len(x))
                key.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                sig.append(signature(x).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), *batch.columns[2:]], names=names)

    return src.mapInArrow(run, schema)


def in_bands(nodes: DataFrame) -> DataFrame:
    """id, number, band: a row for each band of each node. Bands follow from the signatures, so they are not kept beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(np.frombuffer(s, np.uint32)) for s in b.column(1).to_pylist()]
            ids, numbers = np.repeat(b.column(0).to_numpy(), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))], names=["id", "number", "band"])

    return nodes.select("id", "sig").mapInArrow(run, "id long, number int, band long")


@F.pandas_udf(BinaryType())
def last_bytes(sig: pd.Series) -> pd.Series:
    """The lowest byte of each minimum: equal minima agree in it, others once in 256."""
    return pd.Series([np.frombuffer(x, np.uint32).astype(np.uint8).tobytes() for x in sig], dtype=object)


@F.pandas_udf(DoubleType())
def agreeing(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of minima with equal last bytes."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), HASHES) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _full_sets(ids: DataFrame, nodes: DataFrame, df: DataFrame, work: Workspace, size: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """id, members of the given nodes: their full shingle sets, from the whole texts; and the written tables that they are read from."""
    n = nodes.count()
    named = work.settle(nodes.select("id", "rep", "set_key").join(maybe_broadcast(work.settle(ids.distinct(), "wanted", n)), "id", "left_semi"), "named")
    reps = maybe_broadcast(named.select(F.col("rep").alias("doc")).distinct())
    wanted = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(reps, "doc", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            got = [shingles(t, size, known) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in got], pa.binary()), pa.array([x.tobytes() for x in got], pa.binary())], names=["rep", "set_key", "members"])

    full = work.settle(wanted.mapInArrow(sets, "rep long, set_key binary, members binary"), "sets")
    return full.join(named, ["rep", "set_key"]).select("id", "members").dropDuplicates(["id"]), [named, full]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, nodes: DataFrame, df: DataFrame, work: Workspace, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    brief = nodes.select("id", "n_shingles", last_bytes("sig").alias("sig"))
    signed = pairs.join(brief.toDF("a", "n_a", "sig_a"), "a").join(brief.toDF("b", "n_b", "sig_b"), "b")
    close = signed.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(agreeing("sig_a", "sig_b") >= LEAST_AGREEING)
    close = work.settle(close.select("a", "b"), "close")
    full, held = _full_sets(close.select(F.col("a").alias("id")).union(close.select("b")), nodes, df, work, size, id_col, text_col)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = [i for i, (p, q) in enumerate(sets) if similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = close.join(full.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(full.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    links = work.settle(joined.select("a", "b", "ma", "mb").mapInArrow(confirm, "a long, b long"), "links")
    work.drop(close, *held)
    return links


class Group:
    """The rows of one band that one task compares: two blocks, or one with itself."""

    def __init__(self, t: pa.Table, percent: int):
        column = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        self.ids, self.n, self.component, self.percent = column("id"), column("n_shingles"), column("component"), percent
        self.sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        self.number, second = int(column("number")[0]), column("second")
        self.across = bool(column("x")[0] != column("y")[0])
        self.left = np.flatnonzero(~second)
        self.right = np.flatnonzero(second) if self.across else self.left

    def candidates(self, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the first block those it must be compared with, the most agreeing first."""
        for k in self.left:
            r = self.right[(root[self.right] != root[k]) & (100 * np.minimum(self.n[self.right], self.n[k]) >= self.percent * np.maximum(self.n[self.right], self.n[k]))]
            if not self.across:
                r = r[self.ids[r] > self.ids[k]]
            same = self.sig[r] == self.sig[k]
            agree = same.mean(axis=(1, 2))
            r, same, agree = (x[agree >= LEAST_AGREEING] for x in (r, same, agree))
            first = same.all(axis=2).argmax(axis=1) == self.number
            yield k, r[first][np.argsort(-agree[first], kind="stable")]


def _mixed_links(members: DataFrame, nodes: DataFrame, df: DataFrame, work: Workspace, size: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links between different components met in one band: their components (a, b), enough of them to show what is connected.

    members: band, number, id, component. The largest component of a band is dealt to blocks that meet only the blocks of the
    others. Tasks compare the signatures of two blocks and name the rows that have a partner; only these get their full sets.
    """
    spans = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    n = nodes.count()
    mixed = members.join(maybe_broadcast(work.settle(spans, "mixed-bands", n)), "band").join(nodes.select("id", "sig", "n_shingles"), "id")
    mixed = work.settle(mixed, "mixed")
    if not mixed.take(1):
        return None
    parties = mixed.groupBy("band", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    parties = parties.groupBy("band").agg(F.max(F.struct("m", "s", "component")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    parties = parties.select("band", F.col("top.component").alias("party"), blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest"), blocks(F.col("top.m"), F.col("top.s")).alias("more"))
    rows = mixed.join(maybe_broadcast(work.settle(parties, "parties", n)), "band")
    within = F.col("component") == F.col("party")
    dealt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    rows = rows.withColumn("mine", F.when(within, F.col("rest") + dealt(5, "more")).otherwise(dealt(3, "rest")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(within, F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1)))
    rows = rows.select("band", "number", "id", "component", "sig", "n_shingles", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"))
    by = ["band", "x", "y"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Group]]:
        for t, begin in grouped_tables(batches, by, 2 * BLOCK):
            for lo, hi in zip(begin, [*begin[1:], t.num_rows], strict=True):
                if hi - lo > 1:
                    yield (part := t.slice(lo, hi - lo)), Group(part, percent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in groups(batches):
            active = np.zeros(len(g.ids), bool)
            for k, r in g.candidates(g.component):
                active[r] = True
                active[k] |= len(r) > 0
            if active.any():
                yield from t.filter(pa.array(active)).combine_chunks().to_batches()

    active = work.settle(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(meet, rows.schema), "active")
    if not active.take(1):
        return None
    work.drop(mixed)
    full, held = _full_sets(active.select("id"), nodes, df, work, size, id_col, text_col)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in groups(batches):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]
            _, root = np.unique(g.component, return_inverse=True)
            a, b = [], []
            for k, r in g.candidates(root):
                for j in r:
                    if root[j] != root[k] and similar(sets[k], sets[j], percent):
                        a.append(g.component[k])
                        b.append(g.component[j])
                        root[root == root[j]] = root[k]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    whole = active.join(full, "id").repartition(*by).sortWithinPartitions(*by)
    links = work.settle(whole.mapInArrow(confirm, "a long, b long"), "mixed-links")
    work.drop(active, *held)
    return links


def near_duplicates(df: DataFrame, work: Workspace, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group_id for each row: the components of documents with similar sets of word shingles.

    A set holds the distinct shingles of `size` words, or the whole sequence where there are fewer; documents without words have
    empty sets and link with nothing. Links have 100 * intersection >= percent * union. kept: doc_id is the least of its
    component. Rows with a null id are returned unlinked, component null, kept. Rows that repeat an id are judged each by its own
    text; group_id tells their components apart (null without a set). Other columns are left out but those named in `carry`, which must not bear the names of the result.
    """
    carry = list(carry)
    table = work.settle(sketch(df, size, id_col, text_col, carry), "sketches")
    searched = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    # equal sets are one node, numbered as it is written; all that is kept of a set but its least id is equal for all its rows
    same = F.first(F.struct("n_shingles", "sig"))
    nodes = table.where(searched).groupBy("set_key").agg(F.min("doc_id").alias("rep"), same.alias("same"))
    nodes = work.settle(nodes.select(F.monotonically_increasing_id().alias("id"), "rep", "set_key", "same.*"), "nodes")
    classes, n = nodes.select("id", "set_key", "rep"), nodes.count()

    # what the result needs of each row; signatures are kept of distinct sets only
    sketches, table = table, work.settle(table.select("doc_id", "n_shingles", "set_key", *carry), "rows")
    work.drop(sketches)

    member = in_bands(nodes)
    leaders = work.settle(member.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a"), "leaders", 4 * n)
    shared = work.settle(member.join(leaders, "band").select("band", "number", "a", "id"), "shared-bands")
    stars = work.settle(shared.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "star-pairs", n)
    links = _verify(stars, nodes, df, work, size, percent, id_col, text_col)
    work.drop(stars)
    parts = connected_components(links, work)
    labelled = work.settle(shared.select("band", "number", "id").join(maybe_broadcast(parts), "id", "left").select("band", "number", "id", F.coalesce("component_id", "id").alias("component")), "labelled")
    work.drop(shared)
    rest = _mixed_links(labelled, nodes, df, work, size, percent, id_col, text_col)
    work.drop(labelled)
    joined = classes.join(maybe_broadcast(parts), "id", "left").select("id", "set_key", "rep", F.coalesce("component_id", "id").alias("component"))
    if rest is not None and rest.take(1):
        more = connected_components(rest, work).select(F.col("id").alias("component"), F.col("component_id").alias("whole"))
        joined = joined.join(maybe_broadcast(more), "component", "left").withColumn("component", F.coalesce("whole", "component"))
    joined = work.settle(joined.select("set_key", "rep", "component"), "components")
    least = work.settle(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "least-ids", n)
    named = work.settle(joined.join(maybe_broadcast(least), "component").select("set_key", "component_id", F.col("component").alias("group_id")), "named-classes")
    columns = ["doc_id", "n_shingles", "component_id", "group_id", *carry]
    out = table.where(searched).select("doc_id", "n_shingles", "set_key", *carry).join(maybe_broadcast(named), "set_key").select(*columns)
    out = out.unionByName(table.where(~searched).withColumns({"component_id": F.col("doc_id"), "group_id": F.lit(None).cast("long")}).select(*columns))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "group_id", *carry)
