import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import components, spherical, vamana
from wordloom.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n=900, dim=64, seed=1):
    """Rows of which many lie near one another, some just above and below the threshold, with copies."""
    rng, rows = np.random.default_rng(seed), []
    unit = lambda x: x / np.linalg.norm(x)
    while len(rows) < n:
        c = unit(rng.normal(size=dim))
        for _ in range(rng.choice([1, 1, 1, 6, 40])):
            z = rng.normal(size=dim)
            z = unit(z - (z @ c) * c)
            cos = rng.choice([0.92, 0.9295, 0.9305, 0.94, 0.97, 0.999])
            v = (cos * c + np.sqrt(1 - cos * cos) * z) * rng.choice([1.0, 1e-3, 50.0])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
        rows.append((len(rows), c.astype(np.float32).tolist(), rows[-1][2]))
        rows.append((len(rows), rows[-1][1], rows[-1][2]))
    return rows


BAD = [(90001, None, 1), (90002, [0.0] * 64, 1), (90003, [None] + [1.0] * 63, 1), (90004, [float("nan")] + [1.0] * 63, 1), (90005, [float("inf")] + [1.0] * 63, 1), (90006, [1.0] * 64, None), (None, [1.0] * 64, 1), (90007, [], 1), (90008, [1.0] * 3, 1)]


def brute_links(rows, least=0.93):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    comp, before = ids.copy(), None
    while before is None or (comp != before).any():
        before, comp = comp, np.minimum(comp, np.where(linked, comp[None, :], 10**9).min(axis=1))
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), comp, strict=True)}


def linked(spark, rows, extra=()):
    df = spark.createDataFrame([*rows, *extra], SCHEMA).withColumn("key", F.lit(1)).withColumn("filter", F.lit(2))
    return {r["vec_id"]: r for r in spherical.similar_vectors(df, Workspace(spark, "t")).collect()}


def test_similar_vectors(spark):
    rows = clustered()
    got = linked(spark, rows, BAD)
    assert len(got) == len(rows) + len(BAD)
    want = brute_links(rows)
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want
    assert all(got[r[0]]["n_links"] == 0 and got[r[0]]["component_id"] == r[0] and got[r[0]]["kept"] for r in BAD)
    assert linked(spark, []) == {}


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 16, 384])
def test_similar_vectors_of_other_dimensions(spark, dim):
    rows = clustered(400, dim, dim) if dim > 1 else [(i, [float(x)], 0) for i, x in enumerate([1, -2, 3, 3, -4])]
    want = brute_links(rows)
    got = linked(spark, rows)
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want


def test_dense_clusters_are_compared_in_blocks(spark, monkeypatch):
    """Clusters far larger than a block, tight and loose, with parties that share their home filter."""
    monkeypatch.setattr(spherical, "BLOCK", 48)
    rng, rows = np.random.default_rng(9), []
    for spread, n in ((0.02, 500), (0.12, 300), (0.2, 300)):
        c = rng.normal(size=16)
        c /= np.linalg.norm(c)
        rows += [(len(rows) + k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(c + spread * rng.normal(size=(n, 16)) / 4)]
    got, want = linked(spark, rows), brute_links(rows)
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want


@pytest.mark.parametrize("dim", [2, 3, 4, 5, 8, 9, 16, 24, 32, 33, 64, 100, 384])
def test_filters_find_borderline_pairs(dim):
    """Pairs at exactly the threshold; measured on 100,000 pairs for each dimension, see the README."""
    assert borderline(dim, 2000, 2)[0] == 0


def borderline(dim, n, seed):
    """How many of n pairs at cosine 0.93 share 0, 1, 2, ... filters."""
    rng = np.random.default_rng([seed, dim])
    x = spherical.unit_rows(rng.normal(size=(n, dim)))
    z = rng.normal(size=x.shape)
    z = spherical.unit_rows(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    both = np.sort(np.concatenate([spherical.filters_of(v.astype(np.float32)) for v in (x, y)], axis=1), axis=1)
    return np.bincount((both[:, 1:] == both[:, :-1]).sum(axis=1), minlength=1)


@pytest.mark.parametrize("n", [3, 40, 900])
def test_nearest(spark, n):
    rows = clustered()[:n]
    df = spark.createDataFrame(rows + [b for b in BAD if b[0] != 90006], SCHEMA).withColumn("rank", F.lit(1))
    got = {}
    for r in vamana.nearest(df, Workspace(spark, "t"), F.col("vec_id") % 2 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, n, 2):
        s = x @ x[q]
        s[q] = -9
        best = np.lexsort((np.arange(n), -np.round(s, 12)))[: min(5, n - 1)]
        found = [got[q][k + 1] for k in range(len(best))]
        assert len(got[q]) == len(best) and all(abs(v - s[i]) < 1e-12 for i, v in found) and [v for _, v in found] == sorted((v for _, v in found), reverse=True)
        hits += len({int(i) for i in best} & {i for i, _ in found})
        total += len(best)
    assert hits >= 0.9 * total
    assert set(got) == set(range(0, n, 2))


def test_nearest_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 2.0], 0), (3, [0.0, 2.0], 0)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 6)) for r in vamana.nearest(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), F.col("vec_id") < 3).collect()}
    assert got[1, 1] == (3, 1.0) and got[2, 1] == (1, round(1 / np.sqrt(1.01), 6)) and set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_nearest_over_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD", 100)
    monkeypatch.setattr(vamana, "QUERIES", 64)
    test_nearest(spark, 900)


def test_nearest_of_nothing(spark):
    assert vamana.nearest(spark.createDataFrame(BAD[:5], SCHEMA), Workspace(spark, "t"), F.lit(True)).count() == 0
    assert vamana.nearest(spark.createDataFrame([], SCHEMA), Workspace(spark, "t"), F.lit(True)).count() == 0


def test_graph_recall():
    x = spherical.unit_rows(np.random.default_rng(3).normal(size=(1500, 32))).astype(np.float32)
    graph, entry = vamana.build_graph(x)
    found, _ = vamana.beam_search(x, graph, entry, x[:100], vamana.BEAM)
    exact = np.argsort(-(x[:100] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(found.tolist(), exact.tolist(), strict=True)]) >= 0.95
    assert ((graph >= 0).sum(axis=1) <= vamana.DEGREE).all()


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (300, 300), (None, 5)] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 80, (60, 2))]
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(edges, "x long, y long"), Workspace(spark, "t")).collect()}
    whole = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(len(whole)):
        for a, b in edges:
            if a in whole and b in whole:
                whole[a] = whole[b] = min(whole[a], whole[b])
    assert got == whole
    assert components.connected_components(spark.createDataFrame([], "x long, y long"), Workspace(spark, "t")).count() == 0
