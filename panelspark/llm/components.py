"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a minimum per vertex and a join, so no vertex's edges come together in one place. Edges end as stars
around the smallest vertex of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """u, v -> edges to the least neighbour: of the greater neighbours (large), or of the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v (pairs of longs) -> vertex, component (the smallest vertex reachable); vertices without edges are not there.

    Rounds end when each vertex that is no centre has one edge. ``edges`` are read several times in the first round.
    """
    now = edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct()
    while True:
        now = written(_star(_star(now, large=True), large=False), "edges")
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("point"), F.lit(0).alias("centre")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("point"), F.lit(1).alias("centre")))
        if roles.groupBy("x").agg(F.sum("point").alias("point"), F.max("centre").alias("centre")).filter((F.col("point") > 0) & (F.col("point") + F.col("centre") > 1)).isEmpty():
            break
    labels = now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return labels.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
