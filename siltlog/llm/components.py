"""Connected components over a table of links, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the node; nothing but two numbers of a round reaches the
driver. Hubs are aggregated before the shuffle, and the joins are plain equi-joins that adaptive execution
may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    out = both.join(least, both.a == least.node)
    if large:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return out.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) long to (node, root): root is the smallest node reachable. Nodes without links don't appear."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        links = written(_star(_star(links, True), False), "stars")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(own)
