"""Connected components of a table of links, by repeated aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Parts over which the links of a node are dealt out: the centre of a star has as many as there are nodes.
PARTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the least ``m`` of their node a, joined part by part."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int"))
    copies = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, ["a", "part"])


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node of its component.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are hung on its
    smallest neighbour. The number of rounds grows with the logarithm of the number of nodes. Neighbours are never
    collected: minima are aggregated in part before they are shuffled, and the links of a node meet its minimum in PARTS tasks.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        state, k = now, k + 1
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # After a large star every edge goes from a node to a smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), f"{name}-{k}")
