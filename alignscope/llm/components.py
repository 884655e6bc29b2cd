"""Connected components of links that stay distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, join_groups


def _distinct(links: DataFrame) -> DataFrame:
    return links.where("a <> b").distinct()


def _step(links: DataFrame, n: int) -> DataFrame:
    """links: a > b, n of them. Least neighbours are partial minima, and a hub's rows never meet in one task."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = F.count(F.lit(1)).alias("size")
    least = both.groupBy("a").agg(F.min("b").alias("m"), size).select("a", F.least("a", "m").alias("m"), "size")
    upward = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    large = _distinct(join_groups(upward, least, "a", "size", n).select(F.col("b").alias("a"), F.col("m").alias("b")))
    lowest = large.groupBy("a").agg(F.min("b").alias("m"), size)
    small = join_groups(large, lowest, "a", "size", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _distinct(small.unionByName(lowest.select("a", F.col("m").alias("b"))))


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links: a long, b long -> node, label (the smallest node of its component), for every node of a link.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest it knows; the number of
    rounds grows with the logarithm of the largest component. Rounds end only when the links no longer change: then
    each node but the smallest has one link, to the smallest. The result stands in ``tables``.
    """
    now = tables.cut(_distinct(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).first()
        if seen["n"] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        before, now = now, tables.cut(_step(now, seen["n"]))
        tables.drop(before)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
