"""Rows to children. A range join against bounds would be a nested loop; here it is a CASE over few segments, or the bucket
of the row and an equi-join with a bucket -> child map whose size is the window's."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import suffix_col, trunc_col
from ..functions.hashing import remainder_col
from ..plans.config import TableConfig
from ..plans.layout import FILLER, FUTURE, HOT, active_window, branch_children, window_buckets
from ..plans.model import MAX, Segment
from .heat import bucket_of, key_of
from .predicate import branch_condition

#: Up to so many segments a CASE is cheaper than a join.
CASE_SEGMENTS = 40


def zone_of(config: TableConfig, today: date) -> Column:
    lo, hi = active_window(config, today)
    k = key_of(config)
    return F.when(k.isNull(), "default").when(k < F.lit(lo), "archive").when(k < F.lit(hi), "current").otherwise("future")


def archive_child(config: TableConfig) -> Column:
    t = config.table_name
    if config.is_date:
        return F.concat(F.lit(f"{t}_"), suffix_col(trunc_col(key_of(config), config.bucket), config.bucket))
    band, lo = config.archive_band_size, config.active_id_lo
    start = (F.floor((key_of(config) - lo) / band) * band + lo).cast("long")
    return F.concat(F.lit(f"{t}_ids_"), start.cast("string"), F.lit("_"), F.least(start + band, F.lit(lo)).cast("string"))


def _range_case(config: TableConfig, segments: list[Segment], today: date) -> Column:
    k, default = key_of(config), F.lit(f"{config.table_name}_default")
    lo, _ = active_window(config, today)
    out = F.when(k.isNull(), default).when(k < F.lit(lo), archive_child(config))
    for s in segments:
        if s.kind in (FILLER, HOT, FUTURE):
            inside = k >= F.lit(s.start)
            out = out.when(inside if s.end == MAX else inside & (k < F.lit(s.end)), F.lit(s.name))
    return out.otherwise(default)


def child_of(config: TableConfig, segments: list[Segment], today: date) -> Column:
    """The child of each row, as one expression."""
    if config.layout == "hash_branches":
        r = remainder_col(F.col(config.partition_key_column), config.modulus)
        names = F.array(*(F.lit(s.name) for s in segments))
        return F.coalesce(F.get(names, r), F.lit(f"{config.table_name}_default"))
    if config.layout == "list_split":
        out = F.lit(f"{config.table_name}_default")
        for name, branch in reversed(branch_children(config)):
            out = F.when(branch_condition(branch, config.partition_key_column), F.lit(name)).otherwise(out)
        return out
    return _range_case(config, segments, today)


def route(rows: DataFrame, config: TableConfig, segments: list[Segment], today: date, inner: dict[str, tuple[TableConfig, list[Segment]]] | None = None) -> DataFrame:
    """rows with `child`. Rows with a null or unmatched key go to default and are never dropped.

    inner: for composites, the layout and segments inside children of the first level; others are laid out without counts.
    """
    if config.layout in ("hash_branches", "list_split") or len(segments) <= CASE_SEGMENTS:
        routed = rows.withColumn("child", child_of(config, segments, today))
    else:
        lo, hi = active_window(config, today)
        inside = [s for s in segments if s.kind in (FILLER, HOT)]
        pairs = [(b, next(s.name for s in inside if s.start <= b < s.end)) for b, _ in window_buckets(config, today)]
        kind = "date" if config.is_date else "long"
        table = rows.sparkSession.createDataFrame(pairs, f"__b {kind}, __child string")
        k = key_of(config)
        joined = rows.withColumn("__bucket", bucket_of(config)).join(F.broadcast(table), F.col("__bucket") == F.col("__b"), "left")  # a row for each bucket of the window
        child = F.when(k.isNull(), f"{config.table_name}_default").when(k < F.lit(lo), archive_child(config)).when(k >= F.lit(hi), segments[-1].name).otherwise(F.col("__child"))
        routed = joined.withColumn("child", child).drop("__bucket", "__b", "__child")
    if config.child is None:
        return routed
    from ..plans.layout import build_plan

    def suffix(c: TableConfig, own: list[Segment]) -> Column:
        return F.substr(child_of(c, own, today), F.lit(len(c.table_name) + 1))

    name = suffix(config.child, list(build_plan(config.child, today, {}).segments))
    for parent, (c, own) in (inner or {}).items():
        name = F.when(F.col("child") == parent, suffix(c, own)).otherwise(name)
    matched = F.col("child") != F.lit(f"{config.table_name}_default")
    return routed.withColumn("child", F.when(matched, F.concat("child", name)).otherwise(F.col("child")))


def child_counts(rows: DataFrame, config: TableConfig, segments: list[Segment], today: date) -> DataFrame:
    return route(rows, config, segments, today).groupBy("child").agg(F.count(F.lit(1)).alias("n"))
