"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, parts


def _kept(df: DataFrame, rows: int) -> DataFrame:
    return materialise(df, "links", parts(rows))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): root is the least node of its component; nodes without a link to another are absent.

    Every round joins each link with the least neighbour of one end; tables are as long as the links. A node with very
    many links is a skewed join key, which adaptive execution splits.
    """
    rows = links.count()
    e = _kept(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        e = _kept(small.where(F.col("a") != F.col("b")).distinct(), rows)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
