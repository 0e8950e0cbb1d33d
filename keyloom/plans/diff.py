"""Plan differences, gaps, audit and report; and the same on DataFrames of segments."""

from __future__ import annotations

from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import TableConfig
from .layout import active_window
from .model import MAX, AuditResult, Gap, Operation, Plan, PlanReport, Segment, shown

HORIZON_WARNING, CHILD_WARNING = 30, 200
SEGMENT_SCHEMA = "name string, range_start string, range_end string, kind string"


def operations(attached: list[Segment], target: list[Segment]) -> list[Operation]:
    """create, keep or reshape for each target child, drop for each attached one that is no target; by name."""
    old, new = {s.name: s for s in attached}, {s.name: s for s in target}
    out = []
    for name in sorted(old.keys() | new.keys()):
        a, b = old.get(name), new.get(name)
        action = "drop" if b is None else "create" if a is None else "keep" if a.bounds() == b.bounds() else "reshape"
        out.append(Operation(action, b, a))
    return out


def gaps(attached: list[Segment]) -> list[Gap]:
    """Holes and overlaps between neighbours, in the order of their typed bounds, and a missing open end."""
    ranges = sorted((s for s in attached if isinstance(s.start, (date, int))), key=lambda s: (s.start, s.name))
    out = []
    for a, b in zip(ranges, ranges[1:]):
        if a.end != b.start:
            word = "overlap" if a.end == MAX or a.end > b.start else "uncovered range"
            out.append(Gap(a.end, b.start, f"{word} between {a.name} and {b.name}"))
    if ranges and ranges[-1].end != MAX:
        out.append(Gap(ranges[-1].end, MAX, f"no open end after {ranges[-1].name}"))
    return out


def horizon_days(attached: list[Segment], today: date) -> int | None:
    ends = [s.end for s in attached if isinstance(s.end, date)]
    return (max(ends) - today).days if ends else None


def audit(config: TableConfig, attached: list[Segment] | None, default_rows: int | None, today: date) -> AuditResult:
    """attached: None if the table has no catalog; default_rows: None if it has no default child."""
    if attached is None:
        return AuditResult(config.table_name, False, warnings=["table is not partitioned"])
    days, holes, warnings = horizon_days(attached, today), gaps([s for s in attached if s.kind != "archive"]), []
    if config.needs_default and default_rows is None:
        warnings.append("default partition is missing")
    if default_rows:
        warnings.append(f"default partition {config.table_name}_default has {default_rows} rows")
    if days is not None and days < HORIZON_WARNING:
        warnings.append(f"partition horizon is {days} days ahead (below {HORIZON_WARNING})")
    if len(attached) > CHILD_WARNING:
        warnings.append(f"{len(attached)} attached partitions (above {CHILD_WARNING})")
    warnings += [g.message for g in holes]
    return AuditResult(config.table_name, True, default_rows or 0, len(attached), days, holes, warnings)


def report(config: TableConfig, plan: Plan, attached: list[Segment], today: date) -> PlanReport:
    ops = operations(attached, list(plan.segments))
    segment = lambda s: {"name": s.name, "range_start": shown(s.start), "range_end": shown(s.end), "kind": s.kind}
    return PlanReport(
        "1.0", config.table_name, config.layout, today.isoformat(), [shown(b) for b in active_window(config, today)], [shown(b) for b in plan.hot], [segment(s) for s in plan.segments],
        [{"action": o.action, "name": (o.segment or o.attached).name} for o in ops], [asdict(g) for g in gaps(list(plan.segments))], plan.signature(), any(o.action != "keep" for o in ops),
    )


def segments_df(spark: SparkSession, rows: list[Segment]) -> DataFrame:
    text = lambda v: None if v is None else str(shown(v))
    return spark.createDataFrame([(s.name, text(s.start), text(s.end), s.kind) for s in rows], SEGMENT_SCHEMA)


def operations_df(attached: DataFrame, target: DataFrame) -> DataFrame:
    """(action, name) by a full outer join on the name."""
    a = attached.select("name", F.struct("range_start", "range_end").alias("a"))
    b = target.select("name", F.struct("range_start", "range_end").alias("b"))
    action = F.when(F.col("b").isNull(), "drop").when(F.col("a").isNull(), "create").when(F.col("a").eqNullSafe(F.col("b")), "keep").otherwise("reshape")
    return a.join(b, "name", "full_outer").select(action.alias("action"), "name")


def signature_df(segments: DataFrame) -> DataFrame:
    """One row: the plan signature of a table of segments."""
    row = F.concat(F.lit('["'), F.col("name"), F.lit('","'), F.col("range_start"), F.lit('","'), F.col("range_end"), F.lit('","'), F.col("kind"), F.lit('"]'))
    joined = F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]"))
    return segments.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("signature"))


def gaps_df(segments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(name, next_name, gap_start, gap_end, kind) of neighbours that don't meet. Bounds compare as dates; 'max' is open."""
    end = F.when(F.col("range_end") == "max", None).otherwise(F.col("range_end").cast("date"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("range_start").cast("date"), "name")
    rows = segments.withColumn("end_date", end).withColumn("next_name", F.lead("name").over(w)).withColumn("next_start", F.lead(F.col("range_start").cast("date")).over(w))
    open_end = F.col("next_name").isNull() & F.col("end_date").isNotNull()
    apart = F.col("next_name").isNotNull() & ~F.col("end_date").eqNullSafe(F.col("next_start"))
    kind = F.when(open_end, "no_open_end").when(F.col("end_date").isNull() | (F.col("end_date") > F.col("next_start")), "overlap").otherwise("uncovered")
    return rows.where(open_end | apart).select(*(by or []), "name", "next_name", F.col("end_date").alias("gap_start"), F.col("next_start").alias("gap_end"), kind.alias("kind"))
