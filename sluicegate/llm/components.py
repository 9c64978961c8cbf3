"""Connected components of a graph of links, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.base import written


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b); the component is its smallest node.

    Union-find in rounds: every link is hung below the smaller root (large star), roots are
    hung below smaller roots (small star), until nothing moves.  A round is two aggregates and
    two joins on the node; adaptive execution splits a node with many links.  Each round is
    written, so a lost executor costs no earlier round.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components")
    before = _digest(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("low"))
        # Large star: larger neighbours go to the smallest one near the node.
        large = (
            both.where("b > a").join(low, F.col("a") == F.col("node"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(low.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
            .distinct())
        large = written(large, "components")
        # Small star: smaller neighbours too.
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
        small = (
            large.join(least, F.col("a") == F.col("node")).where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
            .distinct())
        edges = written(small, "components")
        # Stars that do not change any more: equal edge sets, known by number and hashes.
        before, last = _digest(edges), before
        if before == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
