"""Connected components by alternating large-star and small-star.

Edges are pairs of long ids.  A large-star step links every larger neighbour of a node
to the smallest of its neighbourhood, a small-star step every smaller one and the node
itself.  Rounds of both end when each node has one edge, to the smallest of its
component.  The rounds grow as the logarithm of the longest path.  Every step is a
partial aggregation and a join, so that a node with many neighbours is no bottleneck, and
every round is written to the checkpoint folder.

Defined cases: self-loops and repeated edges change nothing; null ids are ignored; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.llm.common import dropped, stored, tidy


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")  # made distinct by the other step


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the smallest of each component has one edge, to that smallest."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    with tidy(edges.sparkSession):
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR (up = 1 AND low = 0)").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """id, component (the smallest id of its component) of every id that has an edge to another."""
    now = stored(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        after = stored(_small_star(_large_star(now)))
        dropped(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
