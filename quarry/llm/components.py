"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether the links are disjoint stars: every node points to one other at most, and none is pointed to as well."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionAll(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("low")).where("n > 1 or (n = 1 and low = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): root is the smallest node reachable; every node of an edge once.

    Self-links and nulls are ignored, repeated and reversed links count once, no links give no rows.
    Rounds end when the links are stars around their smallest nodes; links only ever point to smaller nodes.
    Each round is written to the shared folder, so a lost executor costs one round at most.  Minima are
    aggregated before the shuffle and the join that spreads them can be split by skew handling.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(edges):
        edges = materialize(_small_star(_large_star(edges)), "stars")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
