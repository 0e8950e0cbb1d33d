"""Heatmaps: rows per key bucket. One partial aggregation each; what reaches the driver is a row for each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import trunc_col
from ..functions.hashing import remainder_col
from ..plans.config import TableConfig


def key_of(config: TableConfig) -> Column:
    key = F.col(config.partition_key_column)
    return key.cast("date") if config.is_date else key


def bucket_of(config: TableConfig) -> Column:
    """The bucket of each row. Integer bands start at the window's low end, so the grid is the layout's."""
    if config.is_date:
        return trunc_col(key_of(config), config.bucket)
    if config.layout == "integer_window":
        lo, band = config.active_id_lo, config.current_band_size
        return (F.floor((key_of(config) - lo) / band) * band + lo).cast("long")
    return remainder_col(key_of(config), config.modulus) if config.layout == "hash_branches" else key_of(config)


def heatmap(rows: DataFrame, bucket: Column, *by: str) -> DataFrame:
    """(by..., bucket, n)."""
    return rows.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(per_child: DataFrame) -> DataFrame:
    """Counts of a bucket summed over the children it lies in."""
    return per_child.groupBy("bucket").agg(F.sum("n").alias("n"))


def hot_buckets(counts: DataFrame, threshold: int, dedicated: DataFrame | None = None) -> DataFrame:
    """(bucket, n) at or over the threshold; a dedicated child's total (bucket, total) overrides the count."""
    if dedicated is not None:
        counts = counts.join(F.broadcast(dedicated), "bucket", "full_outer").select("bucket", F.coalesce("total", "n").alias("n"))  # rows of a window
    return counts.where(F.col("n") >= threshold)


def distinct_buckets(rows: DataFrame, config: TableConfig) -> DataFrame:
    """The buckets that rows with a key fall in."""
    return rows.where(key_of(config).isNotNull()).select(bucket_of(config).alias("bucket")).distinct()
