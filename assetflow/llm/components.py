"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small


def _state(edges: DataFrame) -> tuple:
    """Tells one edge table from another: the number of edges and three 64-bit sums over their hashes."""
    hashed = edges.select(F.xxhash64("a", "b").alias("h"), F.xxhash64(F.lit("state"), "b", "a").alias("g"))
    return tuple(hashed.agg(F.count("*"), F.bit_xor("h"), F.bit_xor("g"), F.sum(F.shiftright("h", 20))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each step links the neighbours of a node to the smallest of them, so that stars form in a number of steps that is
    logarithmic in practice; sums by node are partial before the shuffle, and no component is ever gathered in one place.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before, most = now, 2 * now[0]
        # Large star: from each node, all larger neighbours go to the smallest one around (or the node).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = small(large.distinct(), most)
        # Small star: from each node, its smaller neighbours and itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        near = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small(near.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), most)
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
