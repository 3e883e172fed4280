"""Near-duplicate vectors by spherical-cap filters with list-decoding in structured random product codes.

Several times: a fast random rotation (signs and Hadamard) and a code whose words are sums of one random codeword from each
block, book^blocks filter directions in all. A vector is list-decoded to the directions with the largest inner products, that is
to all that exceed a threshold of its own; with one threshold for all, vectors that lie badly to the code get none. Sums of two
blocks are listed first and only the best of both halves are combined. Vectors that share a filter are compared; a link counts
in the first filter that both share, the most crowded ones coming first. How many directions there are and how many a vector
takes depends on the dimension (`shape_of`), so that pairs at cosine 0.93 share filters in few and in many dimensions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, grouped_tables, maybe_broadcast
from .components import connected_components

#: For dimensions up to the first number: blocks, codewords of a block, directions that a vector takes of a code, codes.
SHAPES = ((8, (1, 32, 8, 2)), (16, (2, 32, 16, 4)), (32, (4, 16, 32, 4)), (float("inf"), (4, 64, 32, 5)))
#: Members of a filter that one task compares at most with as many others; larger filters are compared block by block.
BLOCK = 1024
#: Groups of at most so many rows are compared many at a time; pairs that are looked at together; vectors decoded together.
SMALL, PAIRS, DECODED = 32, 1 << 16, 256


def shape_of(dim: int) -> tuple[int, int, int, int]:
    return next(s for most, s in SHAPES if dim <= most)


def hadamard(x: np.ndarray) -> np.ndarray:
    h, n = 1, x.shape[1]
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
        x = x.reshape(-1, n)
    return x / np.sqrt(n)


@functools.lru_cache(maxsize=64)
def product_code(dim: int, code: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The padded dimension, three rows of random signs, and the codewords of each block."""
    blocks, book, _, _ = shape_of(dim)
    padded = max(4, 1 << (dim - 1).bit_length())
    rng = np.random.default_rng([dim, code, 77])
    signs = rng.choice([-1.0, 1.0], (3, padded)).astype(np.float32)
    words = rng.normal(size=(blocks, book, padded // blocks)).astype(np.float32)
    return padded, signs, words / np.linalg.norm(words, axis=2, keepdims=True)


def _best(a: np.ndarray, n: int) -> np.ndarray:
    """Of each row the places of its n largest numbers."""
    return np.argpartition(-a, n - 1, axis=1)[:, :n] if n < a.shape[1] else np.broadcast_to(np.arange(a.shape[1]), a.shape)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)


def list_decode(unit: np.ndarray, code: int) -> np.ndarray:
    """Of each unit vector the numbers of the filter directions with the largest inner product, ascending."""
    blocks, book, take, _ = shape_of(unit.shape[1])
    padded, signs, words = product_code(unit.shape[1], code)
    out = []
    for lo in range(0, len(unit), DECODED):
        part = unit[lo : lo + DECODED]
        x = np.zeros((len(part), padded), np.float32)
        x[:, : part.shape[1]] = part
        for s in signs:
            x = hadamard(x * s)
        inner = np.einsum("nbd,bkd->nbk", x.reshape(len(x), blocks, -1), words)
        if blocks < 4:
            whole = inner[:, 0] if blocks == 1 else _sums(inner[:, 0], inner[:, 1])
            out.append(_best(whole, take))
            continue
        a, b = _sums(inner[:, 0], inner[:, 1]), _sums(inner[:, 2], inner[:, 3])
        at_a, at_b = _best(a, take), _best(b, take)
        k = _best(_sums(np.take_along_axis(a, at_a, 1), np.take_along_axis(b, at_b, 1)), take)
        n = at_b.shape[1]
        out.append(np.take_along_axis(at_a, k // n, 1) * book**2 + np.take_along_axis(at_b, k % n, 1))
    found = np.concatenate(out) if out else np.zeros((0, take), np.int64)
    return np.sort(found.astype(np.int64) + code * book**blocks, axis=1)


def filters_of(unit: np.ndarray) -> np.ndarray:
    """The filters of all codes for each unit vector."""
    return np.concatenate([list_decode(unit, c) for c in range(shape_of(unit.shape[1])[3])], axis=1)


def valid_vector(col: str) -> F.Column:
    """Not null, not zero, no null or non-finite component."""
    return F.coalesce(
        F.col(col).isNotNull() & (F.size(col) > 0) & ~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(col, lambda x: x != 0),
        F.lit(False),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; very large and very small rows are scaled twice."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _disjoint(left: np.ndarray, right: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Whether rows left[i] and right[i] have no element in common; row r has flat[start[r]:start[r + 1]]."""
    size = np.diff(start)
    known = np.sort(np.repeat(np.arange(len(size)), size) << 32 | flat)
    out = np.ones(len(left), bool)
    for lo in range(0, len(left) if len(known) else 0, PAIRS):
        a, b = left[lo : lo + PAIRS], right[lo : lo + PAIRS]
        count = size[a]
        pair = np.repeat(np.arange(len(a)), count)
        code = b[pair] << 32 | flat[np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[a], count)]
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        out[lo + pair[known[at] == code]] = False
    return out


def _pairs_of_small(unit: np.ndarray, begin: np.ndarray, size: np.ndarray, across: np.ndarray, second: np.ndarray, start: np.ndarray, flat: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group with cosine >= least and no earlier filter in common, many small groups at a time."""
    head = np.full((len(unit), 4), -1) - np.arange(len(unit))[:, None]  # the first few earlier filters, for a quick look
    for k in range(4):
        has = np.diff(start) > k
        head[has, k] = flat[start[:-1][has] + k]
    for n in np.unique(size[size > 1]):
        i, j = np.triu_indices(n, 1)
        groups, step = np.flatnonzero(size == n), max(1, PAIRS // len(i))
        for lo in range(0, len(groups), step):
            some = groups[lo : lo + step]
            left, right = ((begin[some][:, None] + k).ravel() for k in (i, j))
            use = ~np.repeat(across[some], len(i)) | (second[left] != second[right])
            left, right = left[use], right[use]
            use = ~(head[left][:, :, None] == head[right][:, None, :]).any(axis=(1, 2))
            left, right = left[use], right[use]
            use = np.einsum("pd,pd->p", unit[left], unit[right]) >= least
            left, right = left[use], right[use]
            use = _disjoint(left, right, start, flat)
            yield left[use], right[use]


def _pairs_of_large(unit: np.ndarray, second: np.ndarray | None, start: np.ndarray, flat: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same within one large group."""
    linked = np.triu(unit @ unit.T >= least, 1)
    if second is not None:
        linked &= second[:, None] != second[None, :]
    if linked.any() and len(flat):
        _, name, times = np.unique(flat, return_inverse=True, return_counts=True)
        use = times[name] > 1
        _, name = np.unique(name[use], return_inverse=True)
        holds = np.zeros((len(unit), int(name.max(initial=-1)) + 1), np.float32)
        holds[np.repeat(np.arange(len(unit)), np.diff(start))[use], name] = 1
        linked &= ~((holds @ holds.T) > 0)
    return np.nonzero(linked)


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def links_of(t: pa.Table, begin: np.ndarray, least: float) -> pa.RecordBatch:
    """key, root, n of the rows with links that count here; the groups begin at `begin`, all vectors are equally long."""
    column = lambda c: t.column(c).combine_chunks()
    unit, keys, copies = unit_rows(matrix(column("embedding"))), column("key").to_numpy(), column("copies").to_numpy()
    second, size = column("second").to_numpy(zero_copy_only=False), np.diff(np.append(begin, t.num_rows))
    across = (column("x").to_numpy() != column("y").to_numpy())[begin]
    earlier = column("earlier")
    start, flat = np.append(0, np.cumsum(pc.list_value_length(earlier).to_numpy())), earlier.flatten().to_numpy().astype(np.int64)
    few = size <= SMALL
    found = list(_pairs_of_small(unit, begin[few], size[few], across[few], second, start, flat, least))
    for lo, n, cross in zip(begin[~few], size[~few], across[~few], strict=True):
        at = slice(lo, lo + n)
        a, b = _pairs_of_large(unit[at], second[at] if cross else None, start[lo : lo + n + 1] - start[lo], flat[start[lo] : start[lo + n]], least)
        found.append((a + lo, b + lo))
    left, right = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    n = np.bincount(left, copies[right], len(keys)) + np.bincount(right, copies[left], len(keys))
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.array(keys[_roots(left, right, len(keys))[some]], pa.int64()), pa.array(n[some].astype(np.int64))], names=["key", "root", "n"])


def similar_vectors(df: DataFrame, work: Workspace, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; links join vectors of equal label with cosine >= least.

    Null, zero, null-holding and non-finite vectors, null labels and null ids link with nothing (component: own id; kept). Only
    vectors of equal length are compared. Equal vectors under one label form one class with a count, so copies cost nothing; rows
    that repeat an id are counted as often as they come. Other columns are left out; empty input gives an empty result.
    """
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    src = src.withColumn("ok", valid_vector("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = src.where("ok").select("vec_id", "embedding", "label")
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # classes are numbered as they are written: ids may repeat, and hashes of vectors may collide
    classes = work.settle(classes.select(F.monotonically_increasing_id().alias("key"), "label", "embedding", "id", "copies"), "classes")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.array([len(x) for x in b.column("embedding")])
            for dim in np.unique(lengths):
                part = b.take(pa.array(np.flatnonzero(lengths == dim)))
                filters = filters_of(unit_rows(matrix(part.column("embedding"))).astype(np.float32))
                who = pa.array(np.repeat(np.arange(len(filters)), filters.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("key").take(who), part.column("label").take(who), pa.array(np.full(filters.size, dim), pa.int32()), pa.array(filters.ravel(), pa.int32())], names=["key", "label", "dim", "filter"])

    place, label_type = ["label", "dim", "filter"], src.schema["label"].dataType.simpleString()
    decoded = work.settle(classes.select("key", "label", "embedding").mapInArrow(decode, f"key long, label {label_type}, dim int, filter int"), "filters")
    crowded = work.settle(decoded.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1"), "crowded-filters")
    # each vector's shared filters, the most crowded first; that one is its home
    order = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).otherwise(a["filter"] - b["filter"])
    shared = decoded.join(maybe_broadcast(crowded), place).groupBy("key", "label", "dim").agg(F.array_sort(F.collect_list(F.struct("filter", "n")), order).alias("at"))
    shared = work.settle(shared, "shared-filters")
    work.drop(decoded)
    # vectors with one home have been compared there: in another filter the largest such party meets only the rest
    member = shared.select("key", "label", "dim", F.transform("at", lambda x: x["filter"]).alias("filters"), F.posexplode("at").alias("pos", "here")).select("key", "label", "dim", "filters", "pos", "here.filter", "here.n", F.col("filters")[0].alias("home"))
    parties = member.where((F.col("n") > BLOCK) & (F.col("pos") > 0)).groupBy(*place, "home").agg(F.count("*").alias("m"))
    party = parties.groupBy(*place).agg(F.max_by("home", F.struct("m", "home")).alias("party"), F.max("m").alias("m"))
    member = member.join(maybe_broadcast(work.settle(party, "parties")), place, "left")
    within = F.coalesce((F.col("pos") > 0) & (F.col("home") == F.col("party")), F.lit(False))
    whole = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    dealt = lambda seed, blocks: F.pmod(F.xxhash64("key", F.lit(seed)), F.greatest(blocks, F.lit(1))).cast("int")
    member = member.withColumn("within", within).withColumn("rest", whole(F.col("n") - F.coalesce("m", F.lit(0)))).withColumn("more", whole(F.coalesce("m", F.lit(0))))
    member = member.withColumn("mine", F.when(F.col("within"), F.col("rest") + dealt(5, F.col("more"))).otherwise(dealt(3, F.col("rest"))))
    last = F.when(F.col("within"), F.col("rest")).otherwise(F.col("rest") + F.col("more")) - 1
    member = member.where(last >= 0).select("key", "label", "dim", "filter", F.slice("filters", 1, F.col("pos")).alias("earlier"), "mine", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    rows = member.join(classes.select("key", "embedding", "copies"), "key")
    rows = rows.select("key", "label", "embedding", "copies", "earlier", "dim", "filter", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).alias("second"))
    by = ["label", "dim", "filter", "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in grouped_tables(batches, by):
            dims = t.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = t if (dims == dim).all() else t.filter(pa.array(dims == dim))
                at = begin if part is t else np.searchsorted(np.flatnonzero(dims == dim), begin[dims[begin] == dim])
                yield links_of(part, at, least)

    found = work.settle(rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "key long, root long, n long"), "links")
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select("key", "root").where("key <> root"), work)
    # a component's least vec_id; classes that share an id through repeated rows stay as linked
    whole = classes.select("key", "label", "embedding", "id", "copies").join(links, "key", "left").join(parts.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component_id", "key")).drop("component_id")
    whole = work.settle(whole.select("label", "embedding", "id", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked-classes")
    least_id = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    whole = work.settle(whole.join(least_id, "component").select("label", "embedding", "n_links", "component_id"), "numbered-classes")
    out = good.join(whole, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(src.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
