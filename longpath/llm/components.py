"""Connected components of an edge table by alternating large-star and small-star steps.

A large-star step links every larger neighbour of a node to the least of the node's neighbours and itself; a small-star
step links the smaller neighbours, and the node, to the least of them. Alternated until the edges stay the same, they leave every
node linked to the least node of its component. Each step is an aggregation and a join on the node, so no neighbour list is ever
gathered in a task; the edges are written to the shared folder after each pair of steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longpath.llm.common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge to another; ids of any ordered type."""
    now = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        new = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0))).first()
        if new == mark or new[0] == 0:
            break
        mark, was = new, now
        now = stored(_small_star(_large_star(was)), "edges")
        drop_stored(was)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
