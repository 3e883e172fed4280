import random

import numpy as np
from test_text_operators import brute_components, docs

from wordloom.llm import minhash
from wordloom.llm.common import Workspace


def found(spark, rows, size=5):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows), Workspace(spark, "t"), size).collect()}


def drifting(rng, words, steps, change):
    """Copies of copies, so that the ends of a chain are linked only through its middle."""
    t = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(steps):
        yield " ".join(t)
        for _ in range(change):
            t[rng.randrange(len(t))] = f"z{rng.randint(0, 10**6)}"


def test_chains_and_templates_in_blocks(spark, monkeypatch):
    """Chains, and pages of one template whose bodies differ: many components share bands, in more members than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, rows = random.Random(8), []
    for words in (60, 100, 150):
        rows += list(drifting(rng, words, 40, 1))
    template = [f"t{k}" for k in range(80)]
    for k in range(80):
        body = [f"b{k}.{j}" for j in range(rng.choice([12, 30, 60]))]
        rows += [" ".join(template + body)] + ([" ".join(template + body + ["end"])] if k % 4 == 0 else [])
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute_components(rows, 5, 80)


def test_repeated_ids_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (7, a), (8, b), (9, b + " more")]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows), Workspace(spark, "t")).collect())
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]


def missed_pairs(n, shared, apart, seed):
    """Of n pairs of sets with `shared` common and `apart` other elements: how many no band joins, how many the cut drops."""
    rng, bands, cut = np.random.default_rng(seed), 0, 0
    for _ in range(n):
        x = rng.integers(0, 2**64, shared + apart, dtype=np.uint64)
        half = shared + apart // 2
        p, q = minhash.signature(x[:half]), minhash.signature(np.concatenate([x[:shared], x[half:]]))
        bands += not (p.reshape(-1, minhash.ROWS) == q.reshape(-1, minhash.ROWS)).all(axis=1).any()
        cut += (p == q).mean() < minhash.LEAST_AGREEING
    return bands, cut


def test_pairs_at_the_threshold_are_found():
    """Similarity of exactly 0.8; measured on 100,000 pairs, see the README."""
    assert missed_pairs(3000, 80, 20, 1) == (0, 0)
