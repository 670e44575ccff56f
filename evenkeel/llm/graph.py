"""Connected components of an edge table by alternating stars, each round two joins on aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import kit


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over (a, b) edges, a > b."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(edges.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) edges reaches; roots themselves are left out.

    Rounds grow with the logarithm of the longest chain. Hubs are joined only against one aggregated row, which
    adaptive execution can split.
    """
    edges = kit.checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b"))).first()
        if not now[0] or now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        edges = kit.checkpointed(_stars(edges))
