"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt to islands of a few thousand. An island's individuals are whole packings; their
genes are bins. Crossover injects a partner's well-filled bins, drops the bins that now hold a piece twice, and puts the
displaced pieces back: first in exchange for smaller ones where a bin gets fuller by it, the rest by best fit. Where best-fit
decreasing meets the lower bound, it is proven that no packing is better, and no generation is run. After the first round every island sends the length patterns of its best bins to the
next one, which builds the same bins from its own pieces and goes on evolving. The few badly filled bins that each island
ends with are dissolved and packed again by islands of the next level, until one island is left.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bytes_of
from .common import Workspace, texts

CAPACITY = 2048
#: Pieces of an island; individuals and generations of a round; bin patterns that migrate.
ISLAND, POPULATION, GENERATIONS, MIGRANTS = 4096, 12, 30, 64
#: Generations without a better best after which a round ends.
PATIENCE = 10
#: Bins under this fill are packed again at the next level: at most so many pieces of an island, so many islands together.
WELL_FILLED, LEFT_OVER, FAN_IN = 0.995, 256, 16


# ---- tokens


#: Texts of these characters alone (Latin) are split alike by both libraries, whatever Unicode version each one follows.
OTHER_SCRIPTS = re.compile("[^\x00-\u024f]")


class Encoder:
    """The tokenizer file's ids as little-endian bytes.

    tiktoken merges by the same vocabulary four times as fast; texts with a special token's string or with other scripts than
    Latin go to the tokenizers library itself, so the ids are always those of that library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            ranks = {bytes_of(token): i for token, i in json.load(f)["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or not text.isascii() and OTHER_SCRIPTS.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: the pieces of each row's tokens plus end_id; row numbers all pieces."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        end, row = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for b in batches:
            take, rest = [], []
            for i, text in enumerate(texts(b.column(1))):
                ids = encoder.encode(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                start = 0
                while start < n:
                    length = min(n, capacity) if start else (n % capacity or capacity if n > capacity else n)
                    take.append(i)
                    rest.append((len(rest) and rest[-1][0] + 1 if start else 0, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), row))
                    row += 1
                    start += length
            cols = [pa.array(x, pa.int64()) for x in zip(*rest, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *cols], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return src.mapInArrow(run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, row long")


# ---- the genetic algorithm


def best_fit(items: list[int], size: list[int], bins: list[list[int]], fill: list[int], capacity: int) -> None:
    """Put the items, in their order, each into the fullest bin that has room; opens bins as needed."""
    room: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for b, f in enumerate(fill):
        room[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for i in items:
        s = size[i]
        above = mask >> s
        if above:
            r = s + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
            fill[b] += s
        else:
            b = len(bins)
            bins.append([i])
            fill.append(s)
        r = capacity - fill[b]
        room[r].append(b)
        mask |= 1 << r


def lower_bound(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: by the sum, and by items that can't share a bin (Martello and Toth's second bound)."""
    values = np.sort(np.array(size, np.int64))[::-1]
    total, best = np.append(0, np.cumsum(values)), -(-int(values.sum()) // capacity)
    for k in {0, *values[values <= capacity // 2].tolist()}:
        large = int((values > capacity - k).sum())
        half = int((values > capacity // 2).sum())
        small = int((values >= k).sum())
        middle = int(total[half] - total[large])
        rest = int(total[small] - total[half])
        best = max(best, half + max(0, -(-(rest - ((half - large) * capacity - middle)) // capacity)))
    return best


Packing = tuple[list[list[int]], list[int]]


def fitness(p: Packing, capacity: int) -> tuple[int, float]:
    return -len(p[0]), sum((f / capacity) ** 2 for f in p[1])


def exchange(free: list[int], size: list[int], bins: list[list[int]], fill: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Swap free items for one or two smaller ones of a bin where one or two free ones fill it better; the items free afterwards."""
    loose = sorted((size[i], i) for i in free)
    order = list(range(len(bins)))
    rng.shuffle(order)
    for b in order:
        slack = capacity - fill[b]
        if not slack or not loose:
            continue
        held = bins[b]
        best = 0, None, None
        for out in [(), *((x,) for x in held), *itertools.combinations(held, 2)]:
            gone = sum(size[x] for x in out)
            at = bisect.bisect_right(loose, (gone + slack, 1 << 62)) - 1
            if at < 0:
                continue
            if (gain := loose[at][0] - gone) > best[0]:
                best = gain, out, (at,)
            # two free ones: the largest that leaves room, and what fits beside it
            for first in range(at, max(at - 3, 0), -1):
                second = min(first, bisect.bisect_right(loose, (gone + slack - loose[first][0], 1 << 62))) - 1
                if second >= 0 and (gain := loose[first][0] + loose[second][0] - gone) > best[0]:
                    best = gain, out, (first, second)
            if best[0] == slack:
                break
        gain, out, taken = best
        if gain:
            bins[b] = [x for x in held if x not in out] + [loose[k][1] for k in taken]
            fill[b] += gain
            for k in taken:  # the larger place first
                del loose[k]
            for x in out:
                bisect.insort(loose, (size[x], x))
    return [i for _, i in loose]


def refill(free: list[int], size: list[int], bins: list[list[int]], fill: list[int], capacity: int, rng: random.Random) -> None:
    """Put free items into a packing: exchanges while they help, then best fit, largest first."""
    for _ in range(2):
        before = sum(size[i] for i in free)
        free = exchange(free, size, bins, fill, capacity, rng)
        if sum(size[i] for i in free) == before:
            break
    best_fit(sorted(free, key=lambda i: (-size[i], i)), size, bins, fill, capacity)


def inject(into: Packing, genes: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> Packing:
    """A packing with all bins of genes: bins that share an item with them go, what they held is put back."""
    taken = {i for g in genes for i in g}
    bins, displaced = [list(g) for g in genes], []
    for b in into[0]:
        if taken.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    fill = [sum(size[i] for i in b) for b in bins]
    refill(displaced, size, bins, fill, capacity, rng)
    return bins, fill


def from_patterns(patterns: list[tuple[int, ...]], size: list[int], capacity: int) -> list[list[int]]:
    """Bins of these lengths, as often as the items allow; no item twice."""
    having: dict[int, list[int]] = defaultdict(list)
    for i in range(len(size) - 1, -1, -1):
        having[size[i]].append(i)
    out = []
    for p in patterns:
        need = Counter(p)
        while all(len(having[s]) >= n for s, n in need.items()):
            out.append([having[s].pop() for s in p])
    return out


def evolve(size: list[int], capacity: int, seed: int, elite: Packing | None = None, migrants: list[tuple[int, ...]] = (), population: int = POPULATION, generations: int = GENERATIONS, log: list[int] | None = None) -> Packing:
    """The best packing found; never worse than best-fit decreasing or the elite. log gets the best count of each generation."""
    rng, n, bound = random.Random(seed), len(size), lower_bound(size, capacity)
    key = lambda p: fitness(p, capacity)
    order = sorted(range(n), key=lambda i: (-size[i], i))
    bins, fill = [], []
    best_fit(order, size, bins, fill, capacity)
    people: list[Packing] = [*([elite] if elite else []), (bins, fill)]
    if len(max(people, key=key)[0]) > bound:
        if migrants:
            people.append(inject(people[0], from_patterns(list(migrants), size, capacity), size, capacity, rng))
        while len(people) < population:  # decreasing order, shaken
            bins, fill = [], []
            best_fit(sorted(order, key=lambda i: -size[i] * rng.uniform(0.8, 1.25)), size, bins, fill, capacity)
            people.append((bins, fill))
    people.sort(key=key, reverse=True)
    best, since = key(people[0]), 0
    for _ in range(generations):
        if len(people[0][0]) <= bound or since >= PATIENCE:
            break
        children = []
        for _ in range(max(1, len(people) // 2)):
            a, b = (min(rng.sample(range(len(people)), 2)) for _ in range(2))
            full = sorted(range(len(people[b][0])), key=lambda k: -people[b][1][k])
            genes = [people[b][0][k] for k in full[: max(1, int(len(full) * rng.uniform(0.05, 0.4)))]]
            bins, fill = inject(people[a], genes, size, capacity, rng)
            # mutation: the emptiest bins and some others go
            gone = set(sorted(range(len(bins)), key=lambda k: fill[k])[: max(2, len(bins) // 40)]) | set(rng.sample(range(len(bins)), max(1, len(bins) // 60)))
            free = [i for k in gone for i in bins[k]]
            bins, fill = [bins[k] for k in range(len(bins)) if k not in gone], [fill[k] for k in range(len(bins)) if k not in gone]
            refill(free, size, bins, fill, capacity, rng)
            children.append((bins, fill))
        people = sorted([*people, *children], key=key, reverse=True)[:population]
        best, since = max(best, key(people[0])), 0 if key(people[0]) > best else since + 1
        if log is not None:
            log.append(len(people[0][0]))
    return people[0]


# ---- distributed


def _pack(pdf: pd.DataFrame, capacity: int, seed: int, elite: bool, migrants: list[tuple[int, ...]]) -> pd.DataFrame:
    pdf = pdf.sort_values("row", ignore_index=True)
    size = pdf["length"].tolist()
    start = None
    if elite:
        held: dict[int, list[int]] = defaultdict(list)
        for i, b in enumerate(pdf["bin"].tolist()):
            held[b].append(i)
        start = list(held.values()), [sum(size[i] for i in b) for b in held.values()]
    bins, fill = evolve(size, capacity, seed, start, migrants)
    out = np.zeros((4, len(size)), np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            out[:, i] = k, at, fill[k], len(b)
            at += size[i]
    return pdf.assign(bin=out[0], offset=out[1], fill=out[2], members=out[3])


def _order_of_leaving(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Marks the pieces of the emptiest bins that go to the next level."""
    poor = pdf[pdf["fill"] < WELL_FILLED * capacity].drop_duplicates("bin").sort_values(["fill", "bin"])
    leaving = poor["bin"][poor["members"].cumsum() <= LEFT_OVER]
    return pdf.assign(leaves=pdf["bin"].isin(leaving))


def pack(pieces_df: DataFrame, work: Workspace, capacity: int = CAPACITY, island: int = ISLAND) -> DataFrame:
    """pieces() plus sequence_id and offset. pieces_df must be a written table: its row numbers must not change.

    Pieces that fill a sequence stand alone. Empty input gives an empty result. Ties are broken by row number, so equal input
    gives equal output.
    """
    cols = pieces_df.columns
    short = pieces_df.where(F.col("length") < capacity)
    n = short.count()
    alone = pieces_df.where(F.col("length") >= capacity).select(*cols, (F.col("row") * 4 + 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_df.schema)
    schema = f"{fields}, island long, bin long, offset long, fill long, members long, leaves boolean"
    out_cols = [x.split()[0] for x in schema.split(", ")]

    def alone_round(key, pdf):
        return _order_of_leaving(_pack(pdf, capacity, int(key[0]), False, []), capacity)[out_cols]

    def next_round(key, pdf, sent):
        if not len(pdf):
            return pd.DataFrame({c: [] for c in out_cols})
        patterns = [tuple(map(int, p)) for p in sent.sort_values(["fill", "pattern_key"], ascending=[False, True])["pattern"]]
        return _order_of_leaving(_pack(pdf, capacity, int(key[0]) + 1_000_003, True, patterns), capacity)[out_cols]

    def patterns_of(key, pdf):
        found: Counter = Counter()
        for _, g in pdf.groupby("bin")["length"]:
            found[tuple(sorted(g.tolist(), reverse=True))] += 1
        best = sorted(found, key=lambda p: (-sum(p), -found[p], p))[:MIGRANTS]
        return pd.DataFrame({"island": key[0], "pattern": [list(p) for p in best], "pattern_key": [",".join(map(str, p)) for p in best], "fill": [sum(p) for p in best]})

    finished, level, islands = [], 0, -(-n // island)
    left = short
    while islands:
        dealt = left.select(*cols, F.pmod(F.xxhash64("row", F.lit(level)), F.lit(islands)).alias("island"))
        done = work.settle(dealt.groupBy("island").applyInPandas(alone_round, schema), f"islands-{level}")
        if islands > 1:
            sent = done.groupBy("island").applyInPandas(patterns_of, "island long, pattern array<long>, pattern_key string, fill long")
            sent = work.settle(sent.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))), f"migrants-{level}")
            done = work.settle(done.groupBy("island").cogroup(sent.groupBy("island")).applyInPandas(next_round, schema), f"elites-{level}")
        last = islands == 1
        # even numbers for bins of islands, 4 * x + 3 for sequences that stand alone
        number = (F.lit(level).cast("long") * (1 << 56) + F.col("island") * (1 << 20) + F.col("bin")) * 4
        stay = done if last else done.where(~F.col("leaves"))
        finished.append(stay.select(*cols, number.alias("sequence_id"), "offset"))
        if last:
            break
        left = done.where("leaves")
        islands, level = (-(-islands // FAN_IN) if left.take(1) else 0), level + 1
    out = alone
    for part in finished:
        out = out.unionByName(part)
    return out


def pack_documents(df: DataFrame, work: Workspace, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of length 1 (the end id). Repeated rows are packed as often as they come; null ids stay
    null; other columns are left out; a text of any length is cut into pieces of the capacity, the first of which may be shorter.
    """
    table = work.settle(pieces(df, path, id_col, text_col, capacity), "pieces")
    return pack(table, work, capacity).drop("row")
