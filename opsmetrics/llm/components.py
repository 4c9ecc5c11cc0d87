"""Connected components by alternating stars, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; the root is the smallest node reachable.

    Each round links every neighbour that is larger than a node to the smallest neighbour of it (large star), then
    all smaller ones (small star); the links left are stars around the roots. The number of rounds grows with the
    logarithm of the graph's size; a hot node is grouped with map-side combining, and the join on it is an ordinary
    one that adaptive execution may split. Null ends and self-links are ignored; no links give no rows.
    """
    edges = stored(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _sign(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small_least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = stored(small, "cc")
        now = _sign(edges)
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _sign(edges: DataFrame) -> tuple:
    """A few numbers that two equal sets of links share."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
