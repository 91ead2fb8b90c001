"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.session import clear_staged, stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link: the smallest node it can reach.

    ``links`` holds pairs (a, b) in any order, possibly repeated. Every round hangs the larger
    neighbours of a node, then its smaller ones, on the smallest neighbour; the links become stars
    after a number of rounds that grows with the logarithm of the longest path. Minima are combined
    before the shuffle and hubs of any degree only meet joins, which split; each round is staged.
    """
    spark = links.sparkSession
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage(ends.distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, before = state, now
        now = stage(_small_star(_large_star(before)), "links")
        clear_staged(spark, before)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
