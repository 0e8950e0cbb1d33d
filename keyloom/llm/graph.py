"""Connected components of an edge table, by alternating large-star and small-star steps on staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least node of its neighbourhood."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. Rows are (larger, smaller)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for each node of an edge. edges: two columns of one type.

    A node of very many edges is no hot key for long: the minimum is taken map-side first, and adaptive skew handling splits
    the join. Rounds grow with the logarithm of the longest path. An empty table gives an empty result.
    """
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    mark = None
    while True:  # each round lowers some node's target until none can be lowered
        e = staged(_small_star(_large_star(e)), "components")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
