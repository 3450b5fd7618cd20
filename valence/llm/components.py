"""Connected components of any number of links, by alternating large and small stars.

Each round is joins and grouped minima (Kiveris et al. 2014); a hot node is summed up before the shuffle and
its join partition can be split. The rounds grow with the logarithm of the longest chain. Only a
count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from valence.session import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # The minima as a table, so that the join can split a hot node.
    low = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "minima")
    moved = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links run from the smaller a to the larger b; all smaller ends of b go to the smallest."""
    low = written(links.groupBy("b").agg(F.min("a").alias("m")), "minima")
    ends = links.join(low, "b")
    moved = ends.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for each node of a link a - b (integers)."""
    now = written(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    mark = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if mark == sums:
            break
        mark = sums
        now = written(_small_star(written(_large_star(now), "links")), "links")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
