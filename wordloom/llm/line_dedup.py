"""Line-level deduplication by content-defined chunks of lines.

A rolling hash over the hashes of each two adjacent lines chooses the boundaries: a boundary lies between two lines that stand next to
each other nowhere else. So a boundary depends on the two lines beside it only, and whatever repeats, wherever it stands and whatever
is around it, lies within one chunk. As a chunk may hold several runs that repeat apart, it is compared by its least windows of
LEAST_LINES lines and LEAST_WORDS words, taken at every line, forwards and backwards: a run of that much is the union of the windows
within it. Windows are known by a hash over their lines' hashes; the lines of those that repeat are compared byte for byte, and the
lines of all but the first occurrence go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh, maybe_broadcast, measured_bytes, texts

#: Bytes that are sent to every worker at most: the bits of rolling hashes that repeat, and the hashes of what repeats in documents, which
#: are joined by a shuffle beyond that.
LOOKUP_BYTES = 64 << 20
#: Bits for each rolling hash that repeats, as far as LOOKUP_BYTES allow, and slices in which they are set. Hashes that share a bit make
#: a boundary less and a chunk longer, and change nothing else.
BITS, SLICES = 16, 256
#: Least lines and words of a run that may go.
LEAST_LINES, LEAST_WORDS = 2, 20
#: Lines of one hash but different bytes that are held back at most; none has ever been seen.
CLASHES = 100_000


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """A row of two numbers for each line."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.uint64).reshape(-1, 2)


def rolling(hashes: np.ndarray) -> np.ndarray:
    """A number for each two adjacent lines."""
    x = hashes[:-1, 0] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:, 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def bits_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    """A field of so many bits (a power of two) in which those of the numbers are set."""
    out = np.zeros(bits // 8, np.uint8)
    at = numbers & (bits - 1)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def within(numbers: np.ndarray, field: np.ndarray) -> np.ndarray:
    at = numbers & (8 * len(field) - 1)
    return (field[at >> 3] >> (at & 7)) & 1 == 1


def between_boundaries(lines: list[bytes], hashes: np.ndarray, repeated: np.ndarray | None) -> list[tuple[int, int]]:
    """The chunks of a text that may hold a run, as first line and line after the last, by the bits of the rolling hashes that repeat."""
    ends = np.flatnonzero(~within(rolling(hashes), repeated)) + 1 if repeated is not None else np.zeros(0, np.int64)
    starts = [0, *ends.tolist(), len(lines)]
    return [(a, e) for a, e in zip(starts, starts[1:], strict=False) if e - a >= LEAST_LINES]


def windows(text: bytes, repeated: np.ndarray | None = None) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
    """The text's lines, and the windows that are compared, ordered and overlapping: first line, line after the last, hash.

    Of each line with words: the least window that begins there, the one that also reaches the next line with words, and the same
    backwards. Blank lines at the edges of a run need no windows of their own; so a line is in a bounded number of windows.
    """
    lines = text.split(b"\n")
    if len(lines) < LEAST_LINES:
        return lines, []
    hashes = line_hashes(lines)
    flat, found = hashes.tobytes(), set()
    for first, last in between_boundaries(lines, hashes, repeated):
        counts = {i: len(lines[i].split(None, LEAST_WORDS)) for i in range(first, last)}
        full = [i for i in range(first, last) if counts[i]]
        for k, i in enumerate(full):
            words, e = 0, i
            while e < last and (words < LEAST_WORDS or e - i < LEAST_LINES):
                words += counts[e]
                e += 1
            if words >= LEAST_WORDS and e - i >= LEAST_LINES:
                found.add((i, e))
                if k + 1 < len(full):
                    found.add((i, max(e, full[k + 1] + 1)))
            words, a = 0, i + 1
            while a > first and (words < LEAST_WORDS or i + 1 - a < LEAST_LINES):
                a -= 1
                words += counts[a]
            if words >= LEAST_WORDS and i + 1 - a >= LEAST_LINES:
                found.add((a, i + 1))
                if k:
                    found.add((min(a, full[k - 1]), i + 1))
    return lines, [(a, e, xxhash.xxh3_128_digest(flat[16 * a : 16 * e])) for a, e in sorted(found)]


def chunks(text: bytes, repeated: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    """The windows alone."""
    return windows(text, repeated)[1]


def remove(text: bytes, gone: set[bytes], repeated: np.ndarray | None = None, clashes: frozenset = frozenset()) -> tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text without the windows of these hashes and without repeats of its own; those windows; the removed runs of lines.

    Where a window overlaps its own first occurrence only the lines after that go. Windows with a line of a clashing hash stay.
    """
    spans, runs, firsts = [], [], {}
    lines, found = windows(text, repeated)
    for a, e, h in found:
        at = a
        if h not in gone:
            p, q = firsts.setdefault(h, (a, e))
            if p == a or lines[p:q] != lines[a:e]:
                continue
            at = max(a, q)
        if clashes and any(xxhash.xxh3_128_digest(x) in clashes for x in lines[a:e]):
            continue
        spans.append((a, e))
        runs.append((at, e))
    if not spans:
        return text, [], []
    merged: list[tuple[int, int]] = []
    for a, e in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((a, e))
    out, at = [], 0
    for a, e in merged:
        out += lines[at:a]
        at = e
    return b"\n".join(out + lines[at:]), spans, merged


def _repeated_pairs(src: DataFrame, work: Workspace) -> np.ndarray:
    """The bits of the rolling hashes that stand twice or more. Each slice of them is set in one task, of any number of hashes."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rolling(line_hashes(lines)) for t in texts(b.column(0)) if len(lines := t.split(b"\n")) > 1]
            r, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n.astype(np.int64))], names=["r", "n"])

    twice = work.settle(src.select("text").mapInArrow(roll, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).where("n > 1").select("r"), "rolling-hashes")
    bits = 1 << max(16, min((BITS * twice.count()).bit_length(), (8 * LOOKUP_BYTES).bit_length() - 1))
    width = bits // SLICES

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: dict[int, np.ndarray] = {}
        for b in batches:
            slices, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(slices).tolist():
                fields[k] = fields.get(k, np.zeros(width // 8, np.uint8)) | bits_of(at[slices == k], width)
        yield pa.RecordBatch.from_arrays([pa.array(list(fields), pa.int64()), pa.array([x.tobytes() for x in fields.values()], pa.binary())], names=["slice", "field"])

    at = F.col("r").bitwiseAND(F.lit(bits - 1).cast("long"))
    placed = twice.select(F.floor(at / width).cast("long").alias("slice"), (at % width).alias("at")).repartition("slice")
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.mapInArrow(set_bits, "slice long, field binary").collect():  # LOOKUP_BYTES at most
        out[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["field"], np.uint8)
    work.drop(twice)
    return out


def dedup_lines(df: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with text_col cleaned, plus removed_lines (string of a-b, line numbers from 0, end exclusive: the repeated windows, which
    overlap), removed_runs (the same lines as disjoint runs) and n_lines.

    The first occurrence is that in the row with the least id, there the topmost; it stays. Rows with a null id give way to any
    other row and are never first; rows that share id and text are treated alike. Null texts stay null, empty ones empty; a document
    may become empty. Texts of one line never change. Equal hashes of lines of different bytes (never seen) are left alone, up to
    CLASHES of them; beyond, ValueError.
    """
    df = df.drop("removed_lines", "removed_runs", "n_lines")
    # rows are known by id and text: null ids are no group of their own
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("k"))
    kind = src.schema["doc_id"].dataType.simpleString()
    pairs = df.sparkSession.sparkContext.broadcast(_repeated_pairs(src, work))  # LOOKUP_BYTES at most

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, found = [], []
            for i, t in enumerate(texts(b.column(1))):
                own = {h for _, _, h in chunks(t, pairs.value)}
                who += [i] * len(own)
                found += own
            who = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(2).take(who), pa.array(found, pa.binary())], names=["doc_id", "k", "hash"])

    marked = work.settle(src.mapInArrow(mark, f"doc_id {kind}, k long, hash binary"), "windows")
    often = work.settle(marked.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1 and first is not null").select("hash", "first"), "repeated")
    hits = marked.join(maybe_broadcast(often, LOOKUP_BYTES), "hash").select("doc_id", "k", "hash", (~F.col("doc_id").eqNullSafe(F.col("first"))).alias("goes")).distinct()
    names, listed, doc, k = df.columns, fresh(df, "gone"), fresh(df, "doc"), fresh(df, "key")
    lists = work.settle(hits.groupBy(F.col("doc_id").alias(doc), F.col("k").alias(k)).agg(F.collect_list(F.struct("hash", "goes")).alias(listed)), "hits")  # of one document
    work.drop(marked, often)
    near = F.broadcast(lists) if measured_bytes(lists) <= LOOKUP_BYTES else lists
    key = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(k))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for t, g in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                wanted = {x["hash"] for x in g}
                lines, found = windows(t, pairs.value)
                for i in {i for a, e, h in found if h in wanted for i in range(a, e)}:
                    seen.add((xxhash.xxh3_128_digest(lines[i]), lines[i]))
            cols = [pa.array(x, pa.binary()) for x in zip(*seen, strict=True)] or [pa.array([], pa.binary())] * 2
            yield pa.RecordBatch.from_arrays(cols, names=["hash", "line"])

    held = df.join(near, key).select(F.col(f"`{text_col}`"), listed).mapInArrow(compared, "hash binary, line binary")
    unequal = held.distinct().groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash").take(CLASHES + 1)
    if len(unequal) > CLASHES:
        raise ValueError(f"more than {CLASHES} hashes stand for lines of different bytes")
    clashes, at = frozenset(bytes(r["hash"]) for r in unequal), names.index(text_col)
    joined = df.join(near, key, "left").select(*[F.col(f"`{c}`") for c in names], listed)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, spans, runs, lines = [], [], [], []
            for t, g in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                new, cut, whole = remove(t or b"", {x["hash"] for x in g or () if x["goes"]}, pairs.value, clashes)
                text.append(None if t is None else new)
                spans.append(",".join(f"{a}-{e}" for a, e in cut))
                runs.append(",".join(f"{a}-{e}" for a, e in whole))
                lines.append((t or b"").count(b"\n") + 1)
            cols = [pa.array(text, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.string()), pa.array(runs, pa.string()), pa.array(lines, pa.int64())], names=[*names, "removed_lines", "removed_runs", "n_lines"])

    schema = df.withColumn("removed_lines", F.lit("")).withColumn("removed_runs", F.lit("")).withColumn("n_lines", F.lit(0).cast("long")).schema
    return joined.mapInArrow(clean, schema)
