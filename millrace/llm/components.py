"""Connected components by alternating star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(neighbours: DataFrame) -> DataFrame:
    """Each node of ``a`` hands its smallest neighbour, or itself, to all its neighbours in ``b``."""
    least = neighbours.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return neighbours.join(least, "a")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``; root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller ones, and writes the links; rounds go on until nothing changes.
    No step holds a component in one task: minima are combined before the
    shuffle, and adaptive execution splits the joins of large stars. Nulls are
    no nodes; an empty input gives no rows; repeated links count once.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (seen := _checksum(now)) != before and seen[0]:
        before = seen
        large = _star(_both_ways(now)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        met = _star(down)
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        now = stored(small.where("a != b").distinct(), "links")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
