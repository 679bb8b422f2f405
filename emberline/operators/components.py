"""Connected components as rounds of joins (alternating large-star and small-star steps).

Each round rewires every edge towards the smallest neighbour seen so far, so a component becomes a star
around its smallest node after O(log n) rounds in practice. No group of neighbours is ever collected:
a node's smallest neighbour is an aggregate, and the rewiring is an equi-join that AQE may split on skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import checkpointed


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over (u, v): large star (``both``) or small star."""
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    if both:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(hi.alias("u"), lo.alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if both:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, component): component is the smallest node reachable.

    Nodes without an edge to another node are left out; the caller keeps them as their own component.
    Null ends and self-loops are ignored, repeated edges count once.
    """
    e = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u != v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        e = checkpointed(_star(_star(e, True), False))
        # a star forest: every node points at one centre, and no centre points on
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
