"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.session import stage

MAX_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link; root is the smallest node it is joined to.

    Alternates large stars (neighbours above a node point to the least of its
    neighbourhood) and small stars (neighbours below do) until all links are stars:
    no node has two neighbours below it, or neighbours on both sides. That
    takes a logarithmic number of rounds. Each star is one aggregation with map-side
    combining and one join, whose hot nodes Spark splits; what they give is written to
    the shared folder. Only one flag per round reaches the driver. Links that are stars
    already cost one aggregation.
    """
    now = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        sides = _both_ways(now)
        around = stage(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count_if(F.expr("b < a")).alias("below"), F.max(F.expr("b > a")).alias("above")))
        if around.filter("below > 1 or below = 1 and above").isEmpty():
            return around.select(F.col("a").alias("node"), "root")
        large = stage(sides.filter("b > a").join(around.filter("above").select("a", "root"), "a").select(F.col("b").alias("a"), F.col("root").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        pointed = large.join(least, "a")
        small = pointed.select(F.col("b").alias("a"), F.col("root").alias("b")).unionAll(least.select("a", F.col("root").alias("b")))
        now = stage(small.filter("a <> b").distinct())
    raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")


def more_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of ``links`` and of those that gave ``roots``, for which their stars stand."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links.select("a", "b")))
