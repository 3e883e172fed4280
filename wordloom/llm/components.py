"""Connected components by alternating large-star and small-star, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Workspace

#: Bytes that a node and its minimum take in a broadcast, about.
NODE_BYTES = 64


def _star(edges: DataFrame, work: Workspace, small: bool, few: int | None) -> tuple[DataFrame, DataFrame]:
    """One half step on distinct edges u > v; gives edges u > v again, and the table of minima it reads.

    Large-star sends each neighbour above a node to the least of its neighbourhood, small-star each one below it (and the node
    itself). A node's minimum is aggregated before the shuffle and joined back, so a hub's neighbours never meet in one task:
    both sides of the join are plain shuffles, which Spark splits where they are skewed. `few` bounds the rows if they are so few
    that the minima may be broadcast.
    """
    sides = edges if small else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = work.settle(sides.groupBy("u").agg(F.min("v").alias("m")), "least", few)
    look = F.broadcast(least) if few is not None else least
    if small:
        moved = sides.join(look, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), least
    return sides.where("v > u").join(look, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), least


def connected_components(edges: DataFrame, work: Workspace, most: int = 60) -> DataFrame:
    """id, component_id (least id reachable) for every id that has an edge.

    edges: two integer columns in any order and direction; loops, repeats and null ends are ignored; no edges give no rows.
    Each half step is a written table, deleted when the next one is there. Ends when the edges no longer change: every node then
    hangs on its component's least id.
    """
    a, b = edges.columns[:2]
    start = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(f"`{a}` is not null and `{b}` is not null and u > v")
    now, before = work.settle(start.distinct(), "edges"), None
    rows = 2 * now.count()  # no half step has more edges or nodes than this
    few = rows if rows * NODE_BYTES <= BROADCAST_BYTES else None
    for _ in range(most):
        large, seen = _star(now, work, False, few)
        half = work.settle(large, "half-stars", few)
        work.drop(now, seen)
        small, seen = _star(half, work, True, few)
        now = work.settle(small, "stars", few)
        work.drop(half, seen)
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {most} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select("v", "v").distinct())
