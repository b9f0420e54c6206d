"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, released


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the least vertex that it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Pinned, so that the join reads both sides from an exchange and the edges of one hub can be split.
    least = pinned(both.groupBy("a").agg(F.min("b").alias("m")))
    out = pinned(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
    released(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its smaller neighbours, and itself, to the least of them."""
    least = pinned(edges.groupBy("a").agg(F.min("b").alias("m")))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = pinned(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    released(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least vertex that each vertex of edges (a, b) reaches, for those that reach a lesser one.

    Edges with a null end and loops are left out. Vertices that are the least of their component
    have no row. The number of rounds grows with the logarithm of the longest path; it ends when
    every component is a star: no vertex has two lesser neighbours, and none is both end and centre.
    """
    now = pinned(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not now.isEmpty():
        roles = now.select(F.col("a").alias("v"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionByName(now.select(F.col("b").alias("v"), F.lit(0).alias("end"), F.lit(1).alias("centre")))
        if roles.groupBy("v").agg(F.sum("end").alias("end"), F.max("centre").alias("centre")).where("end > 1 OR end = 1 AND centre = 1").isEmpty():
            break
        was, middle = now, _large_star(now)
        now = _small_star(middle)
        released(was)
        released(middle)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
