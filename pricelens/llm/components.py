"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("root").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b != root")
    moved = moved.select(F.col("b").alias("a"), F.col("root").alias("b"))
    return least.select("a", F.col("root").alias("b")).unionByName(moved).distinct()


def _done(edges: DataFrame) -> bool:
    """Every vertex but the roots has one edge, and that leads to a root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` for every vertex of the edges ``a, b`` (bigint); root is the smallest.

    Loops and repeated edges are harmless, null ends are left out; vertices of loops only have
    no row. A step costs two small shuffles with partial aggregation, and the number of steps
    grows with the logarithm of the longest path. Hubs are split by the adaptive skew join.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a != b")
    edges = cut(_small_star(cut(edges.distinct())))
    while not _done(edges):
        edges = cut(_small_star(_large_star(edges)))
    leaves = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return leaves.unionByName(roots)
