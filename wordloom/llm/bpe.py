"""Byte-pair encoding and decoding with word ends, by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. Each round looks the key of every adjacent pair up by binary
search in the sorted pair keys of the merge list, takes each word's lowest rank, merges all places of that pair from the
left, and closes up the array; words without a known pair leave it. Equal words are encoded once for each batch.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Distinct chunks that a Python worker remembers in each of two generations (bounds memory, not results).
REMEMBERED = 200_000
NO_RANK = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Tables of a tokenizer file of kind BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        names = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.names = [x.encode() for x in names]
        self.digits = [b"%d" % i for i in range(size)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.size = np.int64(size)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.library = None
        self.path = path

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """The pre-tokens of a chunk without ASCII white space; special tokens as ids."""
        if chunk.isalpha():  # ASCII letters only
            return [chunk.lower()]
        if chunk.isascii() and b"<|" not in chunk:
            return PLAIN.findall(chunk.lower())
        text = chunk.decode("utf-8", "replace")
        if LATIN.fullmatch(text):
            return [x.encode() for x in LATIN_WORDS.findall(text.lower())]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        out: list[bytes | int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [bytes_of(x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's begin (one more entry than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends[lengths > 0]] = self.last[flat[ends[lengths > 0]]]
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NO_RANK)
            rank = np.append(rank, NO_RANK)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            best_here = np.repeat(best, sizes)
            going = best_here < NO_RANK
            done_sym.append(sym[~going])
            done_word.append(word[~going])
            hit = going & (rank == best_here)
            # in a run of touching hits (as in "aaa") every second one is merged, from the left
            place = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(place) > 1) if len(place) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(fresh, place, 0)) if len(place) else place
            place = place[(place - start) % 2 == 0]
            sym = sym.copy()
            sym[place] = self.merged[rank[place]]
            going[place + 1] = False
            sym, word = sym[going], word[going]
        ids, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.append(0, np.cumsum(np.bincount(owner, minlength=len(words)))).astype(np.int64)

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk; all words of all chunks go through the merge rounds together."""
        parts = [self.pieces(c) for c in chunks]
        index: dict[bytes, int] = {}
        for p in parts:
            for x in p:
                if x.__class__ is bytes and x not in index:
                    index[x] = len(index)
        ids, at = (x.tolist() for x in self.encode_words(list(index)))
        out = []
        for p in parts:
            got: list[int] = []
            for x in p:
                if x.__class__ is bytes:
                    k = index[x]
                    got += ids[at[k] : at[k + 1]]
                else:
                    got.append(x)
            out.append(got)
        return out

    def decode(self, ids) -> bytes:
        """The tokens joined by one space, which is what a file that names no decoder asks for."""
        return b" ".join([self.names[i] for i in ids])


#: The word pattern for ASCII, and for ASCII with the composed letters of Latin-1, which no normalization changes; other
#: chunks go to the file's own normalizer and splitter.
PLAIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
LATIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_BYTES = str.maketrans({s: chr(b) for b, s in enumerate(byte_symbols())})


def bytes_of(symbols: str) -> bytes:
    return symbols.translate(_BYTES).encode("latin-1")


@functools.lru_cache(maxsize=2)
def model(path: str) -> WordBpe:
    return WordBpe(path)


class Memory(dict):
    """Remembered results of chunks. A full memory becomes the old one, from which what is met again moves back."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def fill(self, chunks: list[bytes], make) -> None:
        unseen = [c for c in dict.fromkeys(chunks) if c not in self]
        if len(self) + len(unseen) > REMEMBERED:
            self.old = dict(self)
            self.clear()
            unseen = list(dict.fromkeys(chunks))
        old = self.old
        self.update([(c, old[c]) for c in unseen if c in old])
        new = [c for c in unseen if c not in old]
        if new:
            self.update(zip(new, make(new), strict=True))


@functools.lru_cache(maxsize=4)
def memory(path: str, kind: str) -> Memory:
    return Memory()


def groups(docs: list[list[bytes]], most: int = 200_000) -> Iterator[list[list[bytes]]]:
    """Documents in runs of bounded word counts."""
    run, n = [], 0
    for d in docs:
        if run and n + len(d) > most:
            yield run
            run, n = [], 0
        run.append(d)
        n += len(d)
    if run:
        yield run


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) plus `out`, the ids of text_col as array<int>.

    Null and empty texts give an empty array; equal rows give equal results; an existing column named `out` is replaced.
    """
    cols = [c for c in (keep if keep is not None else df.columns) if c != out]
    src = df.select(*cols, F.col(text_col).alias("__text"))
    schema = src.drop("__text").withColumn(out, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = model(path), memory(path, "ids")
        for b in batches:
            docs, rows = [t.split() for t in texts(b.column(len(cols)))], []
            for g in groups(docs):
                known.fill([c for d in g for c in d], lambda new: [np.array(x, np.int32) for x in bpe.encode_chunks(new)])
                rows += [np.concatenate([known[c] for c in d]) if d else np.zeros(0, np.int32) for d in g]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(rows, pa.list_(pa.int32()))], names=[*cols, out])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default) plus `out`, the decoded text of ids_col; null ids give the empty text."""
    cols = [c for c in (keep if keep is not None else df.columns) if c != out]
    src = df.select(*cols, F.col(ids_col).alias("__ids"))
    schema = src.drop("__ids").withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            rows = [bpe.decode(x or ()).decode() for x in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(rows, pa.string())], names=[*cols, out])

    return src.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text (null: empty).

    Both digests are of tokens joined by a space, so what a remembered chunk adds to either is remembered with it.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = model(path), memory(path, "digests")

        def make(new: list[bytes]) -> list[tuple[int, bytes, bytes]]:
            return [(len(x), b" ".join([bpe.digits[i] for i in x]), bpe.decode(x)) for x in bpe.encode_chunks(new)]

        for b in batches:
            docs, n, ids, back = [t.split() for t in texts(b.column(1))], [], [], []
            for g in groups(docs):
                known.fill([c for d in g for c in d], make)
                for d in g:
                    got = [known[c] for c in d]
                    n.append(sum([x[0] for x in got]))
                    got = [x for x in got if x[0]]
                    ids.append(hashlib.sha256(b" ".join([x[1] for x in got])).hexdigest())
                    back.append(hashlib.sha256(b" ".join([x[2] for x in got])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
