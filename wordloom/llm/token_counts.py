"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. A word is taken with one leading space, so tokens that begin with the space are the
word-initial pieces and all others the continuing ones. Every node has a failure link (where to go on after the longest
match is popped) and the precomputed number of tokens popped on the way; a word is counted in one pass over its bytes
without building its pieces. Distinct words of a batch advance together through the automaton.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import bytes_of, Memory, groups
from .common import texts

#: Longer words go through the automaton one by one.
TOGETHER = 64


class Automaton:
    """Trie, failure links and popped-token counts of a set of byte strings that holds every single byte."""

    def __init__(self, vocabulary: list[bytes]):
        child: dict[int, int] = {}
        final, depth, byte, parent = [False], [0], [0], [0]
        for token in sorted(set(vocabulary)):
            at = 0
            for c in token:
                to = child.get(at * 256 + c)
                if to is None:
                    to = child[at * 256 + c] = len(final)
                    final.append(False)
                    depth.append(depth[at] + 1)
                    byte.append(c)
                    parent.append(at)
                at = to
            final[at] = True
        fail, pops = [0] * len(final), [0] * len(final)
        for v in sorted(range(1, len(final)), key=depth.__getitem__):
            if final[v]:
                pops[v] = 1
                continue
            if depth[v] == 1:
                raise ValueError(f"the vocabulary lacks the byte {byte[v]}")
            z, n = fail[parent[v]], pops[parent[v]]
            while (to := child.get(z * 256 + byte[v])) is None:
                z, n = fail[z], n + pops[z]
            fail[v], pops[v] = to, n
        if sum(d == 1 for d in depth) < 256:
            raise ValueError("the vocabulary must hold every single byte")
        self.child, self.fail_list, self.pops_list = child, fail, pops
        self.keys = np.sort(np.fromiter(child, np.int64, len(child)))
        self.to = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)

    def count_one(self, word: bytes) -> int:
        at, n, child, fail, pops = 0, 0, self.child, self.fail_list, self.pops_list
        for c in word:
            while (to := child.get(at * 256 + c)) is None:
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of greedy longest-match tokens of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(lengths > TOGETHER):
            out[i] = self.count_one(words[i])
        who = np.flatnonzero((lengths <= TOGETHER) & (lengths > 0))
        flat = np.frombuffer(b"".join([words[i] for i in who]), np.uint8).astype(np.int64)
        end = np.cumsum(lengths[who])
        place, at = end - lengths[who], np.zeros(len(who), np.int64)
        while len(who):
            more = place < end
            key = np.where(more, at * 256 + flat[np.minimum(place, len(flat) - 1)], -1)
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            step = self.keys[k] == key
            out[who] += np.where(step, 0, self.pops[at])
            at = np.where(step, self.to[k], self.fail[at])
            place = place + step
            left = (place < end) | (at > 0)
            if not left.all():
                who, place, end, at = who[left], place[left], end[left], at[left]
        return out


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a tokenizer file of byte-level tokens."""
    with open(path, encoding="utf-8") as f:
        return Automaton([bytes_of(token) for token in json.load(f)["model"]["vocab"]])


@functools.lru_cache(maxsize=2)
def memory(path: str) -> Memory:
    return Memory()


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of each row's whole text; words are what ASCII white space parts.

    Null and empty texts have no words; rows repeat as they come; ids may be null; other columns are left out.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(path), memory(path)
        for b in batches:
            docs, n = [t.split() for t in texts(b.column(1))], []
            for g in groups(docs):
                known.fill([w for d in g for w in d], lambda new: machine.count([b" " + w for w in new]).tolist())
                n += [sum(map(known.__getitem__, d)) for d in g]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, docs), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
