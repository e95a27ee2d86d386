"""Connected components of an edge table, by alternating stars.

Each round links all neighbours of a node to the smallest of them (first the
larger ones, then the smaller ones), which at least squares the reach of the
smallest node.  Minima are partial aggregates and joined back, so a node with
very many neighbours is never gathered in a task.  Each round's edges are a
written table, so lost executors don't bring earlier rounds back.

Cases: edges to itself and repeated edges count for nothing; a node without
edges isn't returned; nulls are not allowed; the empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexstrata.llm.shared import HOT_SHARE, stored

ROUNDS = 60


def _toward_minimum(edges: DataFrame, most: int) -> DataFrame:
    """(u, v, least): each of at most ``most`` edges with the smallest of u and its neighbours v.

    Nodes with over a HOT_SHARE-th of the edges are fewer than that, so their
    minima are broadcast and their edges aren't dealt by node.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count(F.lit(1)).alias("n"))
    hub = F.col("n") * HOT_SHARE > most
    hubs = F.broadcast(least.where(hub).drop("n"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).drop("n"), "u"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is its component's smallest node."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = 2 * state[0]
        large = stored(_toward_minimum(both, most).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct(), "large_edges")
        found = _toward_minimum(large, most)
        small = found.select(F.col("v").alias("u"), F.col("least").alias("v")).union(found.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        now = stored(small, "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
