"""Approximate nearest neighbours on sharded, robust-pruned directed graphs.

Distinct vectors are dealt to shards as large as a task holds. Each shard's graph is built by inserting batches: a greedy search
from the entry point proposes neighbours, pruning with a relaxed distance keeps near but diverse ones, and edges back are pruned
the same way. Queries visit every shard by beam search, in blocks so large that the search takes far longer than the copy of the
shard's index that each block reads; what all shards find is scored exactly and merged.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace
from .spherical import unit_rows, valid_vector

#: Vectors of a shard, edges of a node, beam widths of building and of searching, slack of pruning, queries of a block.
SHARD, DEGREE, BUILD, BEAM, ALPHA, QUERIES = 16_384, 32, 64, 160, 1.2, 32_768
LOCKSTEP = 256


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids (-1: none) and squared distances of the `width` nearest nodes met, nearest first."""
    n, b = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, width), -1, np.int64)
    dist = np.full((n, width), np.inf, np.float32)
    done = np.ones((n, width), bool)
    seen = np.zeros((n, len(x) + 1), bool)  # the last column takes the missing edges
    seen[:, entry] = seen[:, -1] = True
    ids[:, 0], dist[:, 0], done[:, 0] = entry, 2 - 2 * (queries @ x[entry]), False
    live = np.arange(n)
    while len(live):
        rows = live[:, None]
        # the two nearest nodes that are not yet expanded
        take = np.argsort(done[live], axis=1, kind="stable")[:, :2]
        fresh = ~done[rows, take]
        done[rows, take] = True
        node = np.where(fresh, ids[rows, take], len(x))
        near = np.where(node[:, :, None] < len(x), graph[np.minimum(node, len(x) - 1)], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[rows, near], -1, near)
        seen[rows, near] = True
        d = np.where(near >= 0, 2 - 2 * np.matmul(x[near], queries[live][:, :, None])[:, :, 0], np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        at = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], near], axis=1)[at, best]
        done[live] = np.concatenate([done[live], near < 0], axis=1)[at, best]
        dist[live] = all_d[at, best]
        live = live[~done[live].all(axis=1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (-1: none) at most `degree`: the nearest, less those much nearer to one already kept."""
    cand = np.sort(np.where(cand == points[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    d = np.where(cand >= 0, 2 - 2 * np.einsum("bcd,bd->bc", x[cand], x[points]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[cand]
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, out, rows = cand >= 0, np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    for k in range(degree):
        if not alive.any():
            break
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        out[has, k] = cand[rows, first][has]
        alive &= ~((alpha * alpha * between[rows, first] <= d) & has[:, None])
        alive[rows[has], first[has]] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, width: int = BUILD, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of each unit row, and the entry point: the row nearest to the mean."""
    n = len(x)
    entry = int((x @ x.mean(axis=0)).argmax())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(5).permutation(n)
    order = order[order != entry]
    at, size = 0, 1
    while at < len(order):
        new = order[at : at + size]
        at, size = at + size, min(2 * size, LOCKSTEP)
        found, _ = beam_search(x, graph, entry, x[new], width)
        graph[new] = robust_prune(x, new, found, degree, alpha)
        source, target = np.repeat(new, degree), graph[new].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        near = np.argsort(2 - 2 * np.einsum("ed,ed->e", x[source], x[target]), kind="stable")
        near = near[np.argsort(target[near], kind="stable")]
        source, target = source[near], target[near]
        who, start, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(start, count)
        incoming = np.full((len(who), 2 * degree), -1, np.int64)
        fits = rank < 2 * degree
        incoming[np.repeat(np.arange(len(who)), count)[fits], rank[fits]] = source[fits]
        cand = np.concatenate([graph[who], incoming], axis=1)
        full = (cand >= 0).sum(axis=1) > degree
        graph[who[full]] = robust_prune(x, who[full], cand[full], degree, alpha)
        loose = np.sort(cand[~full], axis=1)[:, ::-1]
        graph[who[~full]] = loose[:, :degree]
    return graph, entry


def nearest(df: DataFrame, work: Workspace, queries: F.Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row that meets `queries` (a condition on vec_id).

    Score: cosine in double precision on the original vectors; ties go to the smaller id. Null, zero, null-holding and non-finite
    vectors and null ids take no part; only vectors of equal length are compared. Equal vectors stand in the index once with
    their k + 1 least ids, which is all that a result can show of them. With fewer candidates than k all are returned. A query id
    on several rows gives one answer, that of its least vector; a vec_id on several rows scores as its nearest. Other columns are
    left out; empty input gives an empty result.
    """
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"))
    src = src.where(valid_vector("embedding") & F.col("vec_id").isNotNull())
    # k + 1 least ids of each distinct vector: salted first, so that one vector may hold most rows
    ids = lambda name: F.slice(F.array_sort(F.array_distinct(name)), 1, k + 1)
    w = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    few = src.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).dropDuplicates(["embedding", "vec_id"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    classes = few.groupBy("embedding").agg(ids(F.collect_list("vec_id")).alias("ids"))
    classes = work.settle(classes.select(F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("id"), "ids", "embedding"), "classes")
    sizes = {r["dim"]: max(1, -(-r["n"] // SHARD)) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length
    if not sizes:
        return src.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))
    dealt = classes.select("dim", F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"), "id", "embedding")

    def build(key, pdf):
        pdf = pdf.sort_values("id")
        raw = np.array(pdf["embedding"].tolist())
        graph, entry = build_graph(unit_rows(raw.astype(np.float64)).astype(np.float32))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "index": [pickle.dumps((pdf["id"].to_numpy(), raw, graph.astype(np.int16 if len(raw) < 2**15 else np.int32), entry))]})

    index = work.settle(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, index binary"), "index")
    asked = src.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    asked = work.settle(asked, "queries")
    blocks = -(-asked.count() // QUERIES) or 1
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    asked_all = asked.select("vec_id", "embedding", "dim", block, F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    index_all = index.select("dim", "shard", "index", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(key, shard, ask):
        cols = ["query_id", "id", "score"]
        if not len(shard) or not len(ask):
            return pd.DataFrame({c: [] for c in cols})
        ids, raw, graph, entry = pickle.loads(shard["index"].iloc[0])
        exact = unit_rows(raw.astype(np.float64))
        x, out = exact.astype(np.float32), []
        for lo in range(0, len(ask), LOCKSTEP):
            part = ask.iloc[lo : lo + LOCKSTEP]
            q = unit_rows(np.array(part["embedding"].tolist(), np.float64))
            found, _ = beam_search(x, graph.astype(np.int64), entry, q.astype(np.float32), max(BEAM, k + 1))
            found = found[:, : 2 * k + 2]
            want = min(k + 1, len(x))
            for i in np.flatnonzero((found >= 0).sum(axis=1) < want):  # nodes that no edge reaches
                found[i, :want] = np.argsort(-(x @ q[i].astype(np.float32)), kind="stable")[:want]
            score = np.where(found >= 0, np.einsum("bcd,bd->bc", exact[found], q), -np.inf)
            best = np.lexsort((ids[found], -score), axis=1)[:, : k + 1]
            who = np.repeat(part["vec_id"].to_numpy(), best.shape[1])
            got, score = np.take_along_axis(found, best, 1).ravel(), np.take_along_axis(score, best, 1).ravel()
            out.append(pd.DataFrame({"query_id": who, "id": ids[got], "score": score})[got >= 0])
        return pd.concat(out)

    hits = index_all.groupBy("dim", "shard", "block").cogroup(asked_all.groupBy("dim", "shard", "block")).applyInPandas(search, "query_id long, id long, score double")
    # classes by their least id where they tie
    least = classes.select("id", F.col("ids")[0].alias("least"), "ids")
    hits = hits.join(least, "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "least", "id")
    hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    named = hits.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
