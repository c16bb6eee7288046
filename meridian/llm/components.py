"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialise, release


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours (large star: larger ones; small star: smaller ones and itself) moved to its smallest neighbour."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if both_ways else edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    moved = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if both_ways else joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.where("a < b").distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none that has one is another's."""
    roles = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    found = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return found.where("below + above > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of ``links`` (``a, b``, any order).

    Every node ends as a star round its component's smallest node; a few rounds do, each written to the
    shared folder and deleted once the next is there. Nodes without links aren't in the result."""
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    while not _stars_only(edges):
        last, edges = edges, materialise(_star(_star(edges, True), False), "stars")
        release(last)
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
