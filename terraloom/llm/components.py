"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has a link; label is the smallest node reachable.

    Minima combine map-side before each shuffle and are joined back (a join whose skew adaptive execution splits), so a
    hub is never gathered in one task. Every round is a table in shared storage; rounds grow with the logarithm of the
    longest path, and repeated links do no harm. Null ends and self links carry no link; an empty table gives an empty result.
    """
    edges = links.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        edges = materialize(_small_star(_large_star(edges)))
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u")).union(edges.select("v", F.lit(0))).groupBy("node").agg(
            F.sum("as_u").alias("ups"), F.min("as_u").alias("least"))
        if ends.where("ups > 1 OR ups = 1 AND least = 0").isEmpty():  # every node hangs on one root: nothing can change
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v"), F.col("v")).distinct())
