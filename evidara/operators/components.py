"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.settled import discard, settle


def _with_least(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the least of u and its neighbours in arcs.

    Least ones are combined before the shuffle, so hubs cost one row a task; they are written before the join, so that
    Spark can split the arcs of a hub.
    """
    least = settle(arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
    return arcs.join(least, arcs["u"] == least["_u"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: from larger u to smaller v."""
    near = _with_least(edges)
    arcs = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return arcs.union(near.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, u))")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the least node that is reachable, for every node of an edge. edges: u and v, of one ordered type.

    Edges with a null end and loops are left out; repeated edges count once; without edges the result is empty.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = settle(now, "edges")
    before, state = None, _state(now)
    for _ in range(max_rounds):
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        large = settle(_large_star(now), "large")
        old, now = now, settle(_small_star(large).where("u <> v").distinct(), "edges")
        discard(old, large)
        before, state = state, _state(now)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
