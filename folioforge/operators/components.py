"""Connected components by alternating large-star and small-star rounds.

Every round is a few shuffles of the remaining edges and the number of rounds
grows with the logarithm of the largest component's diameter.  No component is
ever gathered in one task: a hub is the key of an aggregation, not of a list.

Defined results: every node of an edge appears once with the smallest node of
its component; null ends, loops and repeated edges are ignored; no edges give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.session import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or not larger) neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where(F.col("v") <= F.col("u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")) if large else near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    moved = near.where(F.col("v") > F.col("u")) if large else near
    linked = moved.join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    if not large:
        linked = linked.unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return linked.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge."""
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    state = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        new = cut(_star(_star(state, True), False), "cc")
        discard(state)
        state = new
        print_of = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (print_of["n"], print_of["h"]):
            break
        before = (print_of["n"], print_of["h"])
    else:
        raise RuntimeError(f"components weren't complete after {max_rounds} rounds")
    tops = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
