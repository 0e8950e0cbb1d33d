"""The engine's queries over the TPC-H-like tables, each beside the SQL it is checked against."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import calendar as cal
from .operators import heat, move
from .operators.predicate import column_of
from .operators.route import child_counts, route, zone_of
from .plans import config as cfg
from .plans import diff
from .plans.layout import active_window, bound_clause, build_plan
from .plans.maintain import Maintenance
from .plans.model import shown
from .sources.catalog import Catalog
from .streaming.ingest import append_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

O_DAY, O_NEXT, E_DAY = date(2000, 7, 5), date(2000, 8, 13), date(2024, 1, 15)
O = cfg.sliding_monthly("orders", "o_orderdate", ("o_orderkey", "o_orderdate"), split_row_threshold=200, retention_months=24)
E = cfg.sliding_daily("events", "ts", ("event_id", "ts"), active_days=10, split_row_threshold=340)
EW = cfg.sliding_weekly("events", "ts", ("event_id", "ts"), active_weeks=3, split_row_threshold=2325)
OQ = cfg.sliding_quarterly("orders", "o_orderdate", ("o_orderkey",), active_quarters=4, split_row_threshold=600)
OY = cfg.calendar_year("orders", "o_orderdate", ("o_orderkey",), active_years=2, split_row_threshold=2000)
OR = cfg.rolling_current("orders", "o_orderdate", ("o_orderkey",))
I = cfg.integer_window("lineitem", "l_orderkey", ("l_orderkey", "l_linenumber"), active_id_width=10_000, current_band_size=1_000, archive_band_size=10_000, split_row_threshold=4_050)
L = cfg.list_split("orders", "o_orderstatus", ["P", "F"], ("o_orderkey",))
H = cfg.hash_branches("events", "user_id", ("event_id",), modulus=4, split_row_threshold=2_500)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _counts(rows: DataFrame, c: cfg.TableConfig) -> dict:
    return {r.bucket: r.n for r in heat.heatmap(rows, heat.bucket_of(c)).collect()}


def _plan(rows: DataFrame, c: cfg.TableConfig, today: date):
    return build_plan(c, today, _counts(rows, c))


# heatmaps
for _bucket, _load, _key, _sql in (("day", events, "ts", "events"), ("week", events, "ts", "events"), ("month", orders, "o_orderdate", "orders"), ("quarter", orders, "o_orderdate", "orders"), ("year", orders, "o_orderdate", "orders")):
    query(f"heatmap_{_bucket}", f"SELECT CAST(date_trunc('{_bucket}', {_key}) AS DATE) AS bucket, count(*) AS n FROM {_sql} GROUP BY 1")(lambda s, d, f=_load, k=_key, b=_bucket: heat.heatmap(f(s, d), cal.trunc_col(F.col(k), b)))
query("heatmap_int", "SELECT CAST((l_orderkey // 1000) * 1000 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")(lambda s, d: heat.heatmap(lineitem(s, d), heat.bucket_of(I)))
_REM = "CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INTEGER)"
query("heatmap_hash", f"SELECT {_REM} AS bucket, count(*) AS n FROM events GROUP BY 1")(lambda s, d: heat.heatmap(events(s, d), heat.bucket_of(H)))
_STATUS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2"
query("heatmap_per_child", _STATUS)(lambda s, d: heat.heatmap(orders(s, d), cal.trunc_col(F.col("o_orderdate"), "month"), "o_orderstatus"))
query("heatmap_merge_children", f"SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM ({_STATUS}) GROUP BY 1")(lambda s, d: heat.merged(heat.heatmap(orders(s, d), cal.trunc_col(F.col("o_orderdate"), "month"), "o_orderstatus")))
query("hot_buckets_month", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 200")(lambda s, d: heat.hot_buckets(heat.heatmap(orders(s, d), heat.bucket_of(O)), 200))
query("hot_buckets_int", "SELECT CAST((l_orderkey // 1000) * 1000 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 4050")(lambda s, d: heat.hot_buckets(heat.heatmap(lineitem(s, d), heat.bucket_of(I)), 4050))
query("hot_remainders", f"SELECT {_REM} AS bucket, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2500")(lambda s, d: heat.hot_buckets(heat.heatmap(events(s, d), heat.bucket_of(H)), 2500))
_DED = "VALUES (DATE '2000-09-01', CAST(500 AS BIGINT)), (DATE '2000-10-01', CAST(10 AS BIGINT))"
query("hot_dedicated_override", f"WITH h AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1), t(bucket, total) AS ({_DED}) SELECT bucket, coalesce(total, n) AS n FROM h FULL JOIN t USING (bucket) WHERE coalesce(total, n) >= 200")(
    lambda s, d: heat.hot_buckets(heat.heatmap(orders(s, d), heat.bucket_of(O)), 200, s.sql(f"SELECT * FROM {_DED.replace('CAST(500 AS BIGINT)', '500L').replace('CAST(10 AS BIGINT)', '10L')} AS t(bucket, total)"))
)
query("distinct_identifiers", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket FROM orders WHERE o_orderdate IS NOT NULL")(lambda s, d: heat.distinct_buckets(orders(s, d), O))
query("zone_counts", "SELECT CASE WHEN o_orderdate IS NULL THEN 'default' WHEN o_orderdate < '2000-07-01' THEN 'archive' WHEN o_orderdate < '2001-07-01' THEN 'current' ELSE 'future' END AS zone, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: orders(s, d).groupBy(zone_of(O, O_DAY).alias("zone")).agg(F.count(F.lit(1)).alias("n")))

# windows and calendar


@query("active_windows", "SELECT * FROM (VALUES ('month', '2000-07-01', '2001-07-01'), ('day', '2024-01-15', '2024-01-25'), ('week', '2024-01-15', '2024-02-05'), ('quarter', '2000-07-01', '2001-07-01'), ('year', '2000-01-01', '2002-01-01'), ('int', '0', '10000'), ('hash', '0', '4')) t(layout, lo, hi)")
def _windows(s: SparkSession, d: str) -> DataFrame:
    rows = [("month", O, O_DAY), ("day", E, E_DAY), ("week", EW, E_DAY), ("quarter", OQ, O_DAY), ("year", OY, O_DAY), ("int", I, O_DAY), ("hash", H, O_DAY)]
    return s.createDataFrame([(n, *(str(shown(b)) for b in active_window(c, t))) for n, c, t in rows], "layout string, lo string, hi string")


_NAMES = {"day": "strftime(b, 'events_%Y_%m_%d')", "week": "'events_' || CAST(isoyear(b) AS VARCHAR) || '_W' || lpad(CAST(weekofyear(b) AS VARCHAR), 2, '0')", "month": "strftime(b, 'events_%Y_%m')", "quarter": "strftime(b, 'events_%Y') || '_Q' || CAST(quarter(b) AS VARCHAR)", "year": "strftime(b, 'events_%Y')"}
for _b, _n in _NAMES.items():
    query(f"bucket_names_{_b}", f"SELECT b AS bucket, {_n} AS child, CAST(b + INTERVAL 1 {_b} AS DATE) AS next_bucket FROM (SELECT DISTINCT CAST(date_trunc('{_b}', o_orderdate) AS DATE) AS b FROM orders)".replace("INTERVAL 1 quarter", "INTERVAL 3 month").replace("INTERVAL 1 week", "INTERVAL 7 day"))(
        lambda s, d, b=_b: orders(s, d).select(cal.trunc_col(F.col("o_orderdate"), b).alias("bucket")).distinct().select("bucket", F.concat(F.lit("events_"), cal.suffix_col(F.col("bucket"), b)).alias("child"), cal.next_col(F.col("bucket"), b).alias("next_bucket"))
    )
    query(f"parse_names_{_b}", f"SELECT {_n} AS child, b AS bucket FROM (SELECT DISTINCT CAST(date_trunc('{_b}', o_orderdate) AS DATE) AS b FROM orders)")(
        lambda s, d, b=_b: orders(s, d).select(F.concat(F.lit("events_"), cal.suffix_col(cal.trunc_col(F.col("o_orderdate"), b), b)).alias("child")).distinct().select("child", cal.parse_col(F.col("child"), "events", b).alias("bucket"))
    )


# segments
def _segments_sql(table: str, key: str, unit: str, step: str, start: str, end: str, threshold: int, name: str) -> str:
    return f"""
WITH h AS (SELECT CAST(date_trunc('{unit}', {key}) AS DATE) b, count(*) n FROM {table} GROUP BY 1),
w AS (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}' - INTERVAL 1 day, INTERVAL {step})) AS DATE) b),
m AS (SELECT w.b, CAST(w.b + INTERVAL {step} AS DATE) nb, coalesce(n, 0) >= {threshold} hot FROM w LEFT JOIN h USING (b)),
g AS (SELECT *, sum(CAST(hot AS INT)) OVER (ORDER BY b) grp FROM m),
fil AS (SELECT min(b) lo, max(nb) hi FROM g WHERE NOT hot GROUP BY grp),
fn AS (SELECT lo, hi, row_number() OVER (ORDER BY lo) - (CASE WHEN EXISTS (SELECT 1 FROM fil WHERE lo = DATE '{start}') THEN 1 ELSE 0 END) k FROM fil)
SELECT name, range_start, range_end, kind FROM (
  SELECT CASE WHEN lo = DATE '{start}' THEN '{table}_current' WHEN k = 1 THEN '{table}_open' ELSE '{table}_open_' || k END AS name, CAST(lo AS VARCHAR) range_start, CAST(hi AS VARCHAR) range_end, 'filler' AS kind FROM fn
  UNION ALL SELECT {name}, CAST(b AS VARCHAR), CAST(nb AS VARCHAR), 'hot_bucket' FROM m WHERE hot
  UNION ALL SELECT '{table}_future', '{end}', 'max', 'future')"""


_SEG_O = _segments_sql("orders", "o_orderdate", "month", "1 month", "2000-07-01", "2001-07-01", 200, "strftime(b, 'orders_%Y_%m')")
for _n, _load, _c, _t, _sql in (
    ("month", orders, O, O_DAY, _SEG_O),
    ("month_rollover", orders, O, O_NEXT, _segments_sql("orders", "o_orderdate", "month", "1 month", "2000-08-01", "2001-08-01", 200, "strftime(b, 'orders_%Y_%m')")),
    ("day", events, E, E_DAY, _segments_sql("events", "ts", "day", "1 day", "2024-01-15", "2024-01-25", 340, "strftime(b, 'events_%Y_%m_%d')")),
    ("week", events, EW, E_DAY, _segments_sql("events", "ts", "week", "7 day", "2024-01-15", "2024-02-05", 2325, _NAMES["week"])),
    ("quarter", orders, OQ, O_DAY, _segments_sql("orders", "o_orderdate", "quarter", "3 month", "2000-07-01", "2001-07-01", 600, _NAMES["quarter"].replace("events", "orders"))),
    ("year", orders, OY, O_DAY, _segments_sql("orders", "o_orderdate", "year", "1 year", "2000-01-01", "2002-01-01", 2000, "strftime(b, 'orders_%Y')")),
    ("rolling", orders, OR, O_DAY, "SELECT * FROM (VALUES ('orders_current', '2000-07-01', '2001-07-01', 'filler'), ('orders_future', '2001-07-01', 'max', 'future')) t(name, range_start, range_end, kind)"),
):
    query(f"segments_{_n}", _sql)(lambda s, d, f=_load, c=_c, t=_t: diff.segments_df(s, list(_plan(f(s, d), c, t).segments)))
query("segments_int", """
WITH h AS (SELECT CAST((l_orderkey // 1000) * 1000 AS BIGINT) b, count(*) n FROM lineitem GROUP BY 1), w AS (SELECT unnest(range(0, 10000, 1000)) b),
m AS (SELECT w.b, w.b + 1000 nb, coalesce(n, 0) >= 4050 hot FROM w LEFT JOIN h USING (b)), g AS (SELECT *, sum(CAST(hot AS INT)) OVER (ORDER BY b) grp FROM m),
fil AS (SELECT min(b) lo, max(nb) hi FROM g WHERE NOT hot GROUP BY grp),
fn AS (SELECT lo, hi, row_number() OVER (ORDER BY lo) - (CASE WHEN EXISTS (SELECT 1 FROM fil WHERE lo = 0) THEN 1 ELSE 0 END) k FROM fil)
SELECT CASE WHEN lo = 0 THEN 'lineitem_current' WHEN k = 1 THEN 'lineitem_open' ELSE 'lineitem_open_' || k END AS name, CAST(lo AS VARCHAR) AS range_start, CAST(hi AS VARCHAR) AS range_end, 'filler' AS kind FROM fn
UNION ALL SELECT 'lineitem_ids_' || b || '_' || nb, CAST(b AS VARCHAR), CAST(nb AS VARCHAR), 'hot_bucket' FROM m WHERE hot UNION ALL SELECT 'lineitem_future', '10000', 'max', 'future'""")(lambda s, d: diff.segments_df(s, list(_plan(lineitem(s, d), I, O_DAY).segments)))
query("segments_hash", f"WITH h AS (SELECT {_REM} r, count(*) n FROM events GROUP BY 1) SELECT 'events_' || CASE WHEN coalesce(n, 0) >= 2500 THEN 'h' ELSE 'a' END || '_' || lpad(CAST(i AS VARCHAR), 2, '0') AS name, CASE WHEN coalesce(n, 0) >= 2500 THEN 'hot_bucket' ELSE 'archive' END AS kind FROM range(4) t(i) LEFT JOIN h ON r = i")(
    lambda s, d: diff.segments_df(s, list(_plan(events(s, d), H, E_DAY).segments)).select("name", "kind")
)
query("segments_list", "SELECT * FROM (VALUES ('orders_P', 'P', 'branch'), ('orders_F', 'F', 'branch')) t(name, range_start, kind)")(lambda s, d: diff.segments_df(s, list(build_plan(L, O_DAY, {}).segments)).select("name", "range_start", "kind"))
query("bound_clauses", f"SELECT name, 'FOR VALUES FROM (''' || range_start || ''') TO (' || CASE WHEN range_end = 'max' THEN 'MAXVALUE' ELSE '''' || range_end || '''' END || ')' AS clause FROM ({_SEG_O})")(
    lambda s, d: s.createDataFrame([(x.name, bound_clause(x)) for x in _plan(orders(s, d), O, O_DAY).segments], "name string, clause string")
)

# routing


def _routed_sql(seg: str, table: str, key: str, archive: str, lo: str) -> str:
    k = f"CAST({key} AS DATE)"
    return f"(SELECT t.*, CASE WHEN {k} < DATE '{lo}' THEN {archive} ELSE s.name END AS child FROM {table} t LEFT JOIN ({seg}) s ON {k} >= CAST(s.range_start AS DATE) AND (s.range_end = 'max' OR {k} < try_cast(s.range_end AS DATE)))"


_ROUTED_O = _routed_sql(_SEG_O, "orders", "o_orderdate", "strftime(o_orderdate, 'orders_%Y_%m')", "2000-07-01")
query("route_rows_month", f"SELECT o_orderkey, child FROM {_ROUTED_O}")(lambda s, d: route(orders(s, d), O, list(_plan(orders(s, d), O, O_DAY).segments), O_DAY).select("o_orderkey", "child"))
query("route_counts_month", f"SELECT child, count(*) AS n FROM {_ROUTED_O} GROUP BY 1")(lambda s, d: child_counts(orders(s, d), O, list(_plan(orders(s, d), O, O_DAY).segments), O_DAY))
query("route_counts_day", f"SELECT child, count(*) AS n FROM {_routed_sql(ORACLES['segments_day'], 'events', 'ts', _NAMES['day'].replace('b,', 'CAST(ts AS DATE),'), '2024-01-15')} GROUP BY 1")(lambda s, d: child_counts(events(s, d), E, list(_plan(events(s, d), E, E_DAY).segments), E_DAY))
query("route_counts_int", f"SELECT s.name AS child, count(*) AS n FROM lineitem JOIN ({ORACLES['segments_int']}) s ON l_orderkey >= CAST(range_start AS BIGINT) AND (range_end = 'max' OR l_orderkey < try_cast(range_end AS BIGINT)) GROUP BY 1")(lambda s, d: child_counts(lineitem(s, d), I, list(_plan(lineitem(s, d), I, O_DAY).segments), O_DAY))
_LIST = "CASE o_orderstatus WHEN 'P' THEN 'orders_P' WHEN 'F' THEN 'orders_F' ELSE 'orders_default' END"
query("route_counts_list", f"SELECT {_LIST} AS child, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: child_counts(orders(s, d), L, list(build_plan(L, O_DAY, {}).segments), O_DAY))
query("route_counts_hash", f"WITH r AS (SELECT {_REM} AS r, count(*) AS n FROM events GROUP BY 1) SELECT 'events_' || CASE WHEN n >= 2500 THEN 'h' ELSE 'a' END || '_0' || r AS child, n FROM r")(lambda s, d: child_counts(events(s, d), H, list(_plan(events(s, d), H, E_DAY).segments), E_DAY))
_CUST = "CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 4"
query("composite_list_hash_counts", f"SELECT {_LIST} || CASE WHEN o_orderstatus IN ('P', 'F') THEN '_a_0' || ({_CUST}) ELSE '' END AS child, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: child_counts(orders(s, d), (c := cfg.composite_list_hash("orders", "o_orderstatus", ["P", "F"], "o_custkey", 4, ("o_orderkey",))), list(build_plan(c, O_DAY, {}).segments), O_DAY)
)
_RC = "CASE WHEN o_orderdate < '2000-07-01' THEN strftime(o_orderdate, '_%Y_%m') WHEN o_orderdate < '2001-07-01' THEN '_current' ELSE '_future' END"
query("composite_list_range_counts", f"SELECT {_LIST} || CASE WHEN o_orderstatus IN ('P', 'F') THEN {_RC} ELSE '' END AS child, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: child_counts(orders(s, d), (c := cfg.composite_list_range("orders", "o_orderstatus", ["P", "F"], "o_orderdate", ("o_orderkey",))), list(build_plan(c, O_DAY, {}).segments), O_DAY)
)
query("composite_range_hash_counts", f"SELECT 'orders' || {_RC} || '_a_0' || ({_CUST}) AS child, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: child_counts(orders(s, d), (c := cfg.composite_range_hash("orders", "o_orderdate", "o_custkey", 4, ("o_orderkey",))), list(build_plan(c, O_DAY, {}).segments), O_DAY)
)
query("composite_range_list_counts", f"SELECT 'orders' || {_RC} || substr({_LIST}, 7) AS child, count(*) AS n FROM orders GROUP BY 1")(
    lambda s, d: child_counts(orders(s, d), (c := cfg.composite_range_list("orders", "o_orderdate", "o_orderstatus", ["P", "F"], ("o_orderkey",))), list(build_plan(c, O_DAY, {}).segments), O_DAY)
)

# predicates: status O stands for null
_NULLED = "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders"
for _op, _cond in (("eq", "status = 'F'"), ("ne", "status <> 'F'"), ("is_null", "status IS NULL"), ("is_not_null", "status IS NOT NULL")):
    query(f"predicate_{_op}", f"SELECT o_orderkey FROM ({_NULLED}) WHERE {_cond}")(
        lambda s, d, op=_op: orders(s, d).select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("status")).where(column_of({"column": "status", "operator": op, "value": "F"})).select("o_orderkey")
    )

# plans
_SEG_O2 = ORACLES["segments_month_rollover"]
_DIFF = f"SELECT CASE WHEN t.name IS NULL THEN 'drop' WHEN a.name IS NULL THEN 'create' WHEN a.range_start = t.range_start AND a.range_end = t.range_end THEN 'keep' ELSE 'reshape' END AS action, coalesce(a.name, t.name) AS name FROM ({_SEG_O}) a FULL JOIN ({_SEG_O2}) t ON a.name = t.name"


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = _counts(orders(s, d), O)
    return tuple(diff.segments_df(s, list(build_plan(O, t, counts).segments)) for t in (O_DAY, O_NEXT))


query("plan_diff", _DIFF)(lambda s, d: diff.operations_df(*_two(s, d)))
query("plan_changed", f"SELECT count(*) FILTER (action <> 'keep') > 0 AS changed FROM ({_DIFF})")(lambda s, d: diff.operations_df(*_two(s, d)).agg((F.count_if(F.col("action") != "keep") > 0).alias("changed")))
query("plan_signature", f"""SELECT substr(sha256('[' || string_agg(r, ',' ORDER BY r) || ']'), 1, 16) AS signature FROM (SELECT '["' || name || '","' || range_start || '","' || range_end || '","' || kind || '"]' AS r FROM ({_SEG_O}))""")(lambda s, d: diff.signature_df(_two(s, d)[0]))
_GAP_SQL = "WITH v(name, range_start, range_end, kind) AS (VALUES {0}), x AS (SELECT name, try_cast(range_end AS DATE) e, lead(name) OVER w AS next_name, lead(CAST(range_start AS DATE)) OVER w AS ns FROM v WINDOW w AS (ORDER BY CAST(range_start AS DATE), name)) SELECT name, next_name, e AS gap_start, ns AS gap_end, CASE WHEN next_name IS NULL THEN 'no_open_end' WHEN e IS NULL OR e > ns THEN 'overlap' ELSE 'uncovered' END AS kind FROM x WHERE (next_name IS NULL AND e IS NOT NULL) OR (next_name IS NOT NULL AND e IS DISTINCT FROM ns)"
for _n, _rows in (("gaps", "('t_current', '2026-07-01', '2026-10-01', 'filler'), ('t_future', '2027-01-01', 'max', 'future')"), ("gaps_no_max_tail", "('t_current', '2026-07-01', '2027-01-01', 'filler'), ('t_open', '2026-12-01', '2027-07-01', 'filler')")):
    query(_n, _GAP_SQL.format(_rows))(lambda s, d, r=_rows: diff.gaps_df(s.sql(f"SELECT * FROM VALUES {r} AS v(name, range_start, range_end, kind)")))

# archive, drain, retention, premake
query("default_drain_remaining", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P', 'F') OR o_orderstatus IS NULL")(lambda s, d: route(orders(s, d), L, list(build_plan(L, O_DAY, {}).segments), O_DAY).where("child = 'orders_default'").select("o_orderkey"))


# maintenance that writes, commits and reads back
def _root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/keyloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="keyloom-")


def _maintained(s: SparkSession, d: str, *days: date, config: cfg.TableConfig = O) -> tuple[Maintenance, Catalog]:
    rows = orders(s, d).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    catalog = Catalog(s, _root(s))
    Maintenance(catalog, days[0]).create(config, rows)
    for day in days:
        m = Maintenance(catalog, day)
        m.run_table(config)
    return m, catalog


_MONTH = "strftime(o_orderdate, 'orders_%Y_%m')"
query("archive_finalize_counts", f"SELECT {_MONTH} AS child, count(*) AS rows FROM orders WHERE o_orderdate < '2000-07-01' GROUP BY 1")(lambda s, d: _maintained(s, d, O_DAY)[1].children_df("orders").where("kind = 'archive'").select("child", "rows"))
query("retention_preview", f"SELECT DISTINCT {_MONTH} AS child FROM orders WHERE o_orderdate < '1998-07-01'")(lambda s, d: s.createDataFrame([(n,) for n in _maintained(s, d, O_DAY)[0].retention(O)], "child string"))
query("retention_remaining", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-07-01'")(lambda s, d: _maintained(s, d, O_DAY, config=replace(O, retention_apply=True))[1].read("orders").select("o_orderkey"))
PM = cfg.premake_monthly("orders", "o_orderdate", ("o_orderkey",), premake_months=3)
_PREMADE = "SELECT strftime(b, 'orders_%Y_%m') AS child, CAST(b AS DATE) AS b FROM (SELECT unnest(generate_series(DATE '2000-07-01', DATE '2000-10-01', INTERVAL 1 month)) AS b)"
query("premake_missing", f"SELECT child FROM ({_PREMADE})")(lambda s, d: s.createDataFrame([(x.name,) for x in _maintained(s, d, O_DAY, config=PM)[1].attached("orders")], "child string"))
query("premake_drained_counts", f"SELECT child, (SELECT count(*) FROM orders WHERE o_orderdate >= b AND o_orderdate < b + INTERVAL 1 month) AS rows FROM ({_PREMADE}) UNION ALL SELECT 'orders_default', count(*) FROM orders WHERE o_orderdate < '2000-07-01' OR o_orderdate >= '2000-11-01' OR o_orderdate IS NULL")(
    lambda s, d: _maintained(s, d, O_DAY, config=PM)[1].children_df("orders").select("child", "rows")
)
LH = cfg.composite_list_hash("orders", "o_orderstatus", ["P", "F"], "o_custkey", 4, ("o_orderkey",))
RH = cfg.composite_range_hash("orders", "o_orderdate", "o_custkey", 4, ("o_orderkey",))
query("composite_maintained_counts", f"SELECT child, n AS rows FROM ({ORACLES['composite_list_hash_counts']})")(lambda s, d: _maintained(s, d, O_DAY, config=LH)[1].children_df("orders").select("child", "rows"))
query("composite_range_maintained_counts", f"SELECT child, n AS rows FROM ({ORACLES['composite_range_hash_counts']}) UNION ALL SELECT 'orders_default', 0")(lambda s, d: _maintained(s, d, O_DAY, config=RH)[1].children_df("orders").select("child", "rows"))
query("horizon_days", f"SELECT max(try_cast(range_end AS DATE)) - DATE '2000-07-05' AS horizon_days FROM ({_SEG_O})")(lambda s, d: s.createDataFrame([(diff.horizon_days(_maintained(s, d, O_DAY)[1].attached("orders"), O_DAY),)], "horizon_days long"))


@query("int_bounded_read_after_append", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 950 AND l_orderkey < 1500 AND l_orderkey % 3 = 0 UNION ALL SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 950 AND l_orderkey < 1500 AND l_orderkey % 3 > 0")
def _appended(s: SparkSession, d: str) -> DataFrame:
    rows, catalog = lineitem(s, d), Catalog(s, _root(s))
    m = Maintenance(catalog, O_DAY)
    m.create(I, rows.where("l_orderkey % 3 = 0"))
    m.run_table(I)
    append_batch(catalog, I, rows.where("l_orderkey % 3 = 1"), O_DAY, 0, "a")
    append_batch(catalog, I, rows.where("l_orderkey % 3 = 2"), O_DAY, 0, "b")
    return catalog.read("lineitem", key_range=(950, 1500)).select("l_orderkey", "l_linenumber")



_FINAL = "SELECT child, count(*) AS rows FROM {0} GROUP BY 1 UNION ALL SELECT 'orders_default', 0"
query("rebalance_final_counts", _FINAL.format(_ROUTED_O))(lambda s, d: _maintained(s, d, O_DAY)[1].children_df("orders").select("child", "rows"))
query("rollover_final_counts", _FINAL.format(_routed_sql(_SEG_O2, "orders", "o_orderdate", "strftime(o_orderdate, 'orders_%Y_%m')", "2000-08-01")))(lambda s, d: _maintained(s, d, O_DAY, O_NEXT)[1].children_df("orders").select("child", "rows"))
query("rebalance_idempotent", "SELECT CAST(0 AS BIGINT) AS rows_moved, false AS changed")(lambda s, d: s.createDataFrame([((r := _maintained(s, d, O_DAY)[0].rebalance(O))[0], r[2])], "rows_moved long, changed boolean"))
query("audit_summary", f"SELECT 'orders' AS table_name, true AS partitioned, (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) AS default_row_count, (SELECT max(try_cast(range_end AS DATE)) - DATE '2000-07-05' FROM ({_SEG_O})) AS horizon_days, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS warnings")(
    lambda s, d: s.createDataFrame([((a := _maintained(s, d, O_DAY)[0].audit(O)).table_name, a.partitioned, a.default_row_count, a.horizon_days, len(a.gaps), len(a.warnings))], "table_name string, partitioned boolean, default_row_count long, horizon_days long, gaps long, warnings long")
)
query("bounded_read", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '2000-10-01' AND o_orderdate < '2000-11-01'")(lambda s, d: _maintained(s, d, O_DAY)[1].read("orders", key_range=(date(2000, 10, 1), date(2000, 11, 1))).select("o_orderkey"))
query("two_level_read", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '2000-10-01' AND o_orderdate < '2000-11-01' AND o_orderstatus = 'F'")(lambda s, d: _maintained(s, d, O_DAY)[1].read("orders", key_range=(date(2000, 10, 1), date(2000, 11, 1))).where("o_orderstatus = 'F'").select("o_orderkey"))
query("id_only_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 70, 700)")(lambda s, d: _maintained(s, d, O_DAY)[1].read("orders").where("o_orderkey IN (7, 70, 700)").select("o_orderkey", "o_totalprice"))


@query("hot_switch_roundtrip", "SELECT * FROM (VALUES ('before', (SELECT count(*) FROM orders)), ('switched', (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0)), ('back', (SELECT count(*) FROM orders))) t(step, rows)")
def _switch(s: SparkSession, d: str) -> DataFrame:
    rows = orders(s, d).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    catalog, shadow = Catalog(s, _root(s)), cfg.sliding_monthly("shadow", "o_orderdate", O.conflict_key)
    m = Maintenance(catalog, O_DAY)
    m.create(O, rows)
    m.create(shadow, rows.where("o_orderkey % 2 = 0"))
    out = [("before", catalog.read("orders").count())]
    catalog.switch("orders", "shadow")
    out.append(("switched", catalog.read("orders").count()))
    catalog.unswitch("orders", "shadow")
    return s.createDataFrame([*out, ("back", catalog.read("orders").count())], "step string, rows long")


@query("cutover_children", _FINAL.format(_ROUTED_O))
def _cutover_children(s: SparkSession, d: str) -> DataFrame:
    """The children of a live name after its shadow took it over, and after one more run of maintenance."""
    catalog, shadow = Catalog(s, _root(s)), replace(O, table_name="shadow")
    m = Maintenance(catalog, O_DAY)
    m.create(O, orders(s, d))
    m.create(shadow, orders(s, d))
    m.run_table(shadow)
    catalog.switch("orders", "shadow")
    m.run_table(O)
    return catalog.children_df("orders").select("child", "rows")


_BEHIND = "o_orderkey % 5 <> 0"


@query(
    "delta_synced",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND NOT (o_orderdate >= '2000-04-01' AND o_orderdate < '2000-10-01') THEN o_totalprice - 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE {_BEHIND} OR (o_orderdate >= '2000-04-01' AND o_orderdate < '2000-10-01')",
)
def _delta_synced(s: SparkSession, d: str) -> DataFrame:
    """A shadow that lacks rows and holds older ones, after its sync with the live table."""
    catalog, shadow = Catalog(s, _root(s)), replace(O, table_name="shadow")
    m, o = Maintenance(catalog, O_DAY), orders(s, d)
    m.create(O, o)
    m.create(shadow, o.where(_BEHIND).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") - 1).otherwise(F.col("o_totalprice")).cast(o.schema["o_totalprice"].dataType)))
    m.run_table(shadow)
    m.sync("orders", shadow, "o_totalprice")
    return catalog.read("shadow").select("o_orderkey", "o_totalprice")


# moves and paging
_CUR = ["o_orderdate", "o_orderkey"]


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = orders(s, d)
    return o.where("o_orderkey % 10 IN (0, 1, 2)"), o.where("o_orderkey % 10 IN (2, 3)")


query("move_dedupe_dest", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 3)")(lambda s, d: move.moved(*_split(s, d), F.lit(True), ["o_orderkey", "o_orderdate"], _CUR)[1].select("o_orderkey"))
query("move_stats", "SELECT count(*) AS batch_size, count(*) FILTER (o_orderkey % 10 <> 2) AS inserted, count(*) FILTER (o_orderkey % 10 = 2) AS duplicates, max(o_orderdate) AS last_o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_o_orderkey FROM orders WHERE o_orderkey % 10 IN (0, 1, 2)")(
    lambda s, d: move.move_stats(*_split(s, d), F.lit(True), ["o_orderkey", "o_orderdate"], _CUR)
)
query("move_duplicates", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 2")(lambda s, d: move.duplicates(*_split(s, d), ["o_orderkey", "o_orderdate"]).select("o_orderkey"))
query("uniqueness_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: move.violations(lineitem(s, d), ["l_orderkey", "l_linenumber"]))
_PAGE = "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '2000-07-05', 0) ORDER BY 1, 2 LIMIT 5"
_page = lambda s, d: move.keyset_page(orders(s, d), _CUR, (F.lit("2000-07-05").cast("timestamp_ntz"), F.lit(0).cast("long")), 5).select(*_CUR)
query("keyset_page", _PAGE)(_page)
query("keyset_last_cursor", f"SELECT * FROM ({_PAGE}) ORDER BY 1 DESC, 2 DESC LIMIT 1")(lambda s, d: move.last_cursor(_page(s, d), _CUR))

# cutover
_TARGET = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ts - INTERVAL 1 hour ELSE ts END AS ts, user_id, CASE WHEN event_id % 7 = 0 THEN 'old' ELSE event_type END AS event_type FROM events WHERE event_id % 5 <> 0"


def _target(s: SparkSession, d: str) -> DataFrame:
    old = F.col("event_id") % 7 == 0
    e = events(s, d).where("event_id % 5 <> 0")
    return e.select("event_id", F.when(old, F.col("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("ts"), "user_id", F.when(old, "old").otherwise(F.col("event_type")).alias("event_type"))


query("delta_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1998-02-01' AND o_orderdate < '1998-08-01'")(lambda s, d: orders(s, d).where((F.col("o_orderdate") >= F.lit((w := move.delta_window(date(1998, 5, 20)))[0])) & (F.col("o_orderdate") < F.lit(w[1]))).select("o_orderkey"))
query("delta_to_sync_count", f"SELECT count(*) AS n FROM events s WHERE NOT EXISTS (SELECT 1 FROM ({_TARGET}) t WHERE t.event_id = s.event_id AND t.ts >= s.ts)")(lambda s, d: move.to_sync(events(s, d), _target(s, d), ["event_id"], "ts").agg(F.count(F.lit(1)).alias("n")))
query("delta_upsert", f"SELECT coalesce(CASE WHEN t.ts >= s.ts THEN t.event_id END, s.event_id, t.event_id) AS event_id, CASE WHEN t.ts >= s.ts THEN t.ts ELSE s.ts END AS ts, CASE WHEN t.ts >= s.ts THEN t.user_id ELSE s.user_id END AS user_id, CASE WHEN t.ts >= s.ts THEN t.event_type ELSE s.event_type END AS event_type FROM events s FULL JOIN ({_TARGET}) t ON s.event_id = t.event_id")(
    lambda s, d: move.upserted(events(s, d), _target(s, d), ["event_id"], "ts")
)
query("compare_counts", f"SELECT (SELECT count(*) FROM events) AS current_rows, (SELECT count(*) FROM ({_TARGET})) AS shadow_rows, (SELECT count(*) FROM events) - (SELECT count(*) FROM ({_TARGET})) AS difference")(
    lambda s, d: events(s, d).agg(F.count(F.lit(1)).alias("current_rows")).crossJoin(F.broadcast(_target(s, d).agg(F.count(F.lit(1)).alias("shadow_rows")))).withColumn("difference", F.col("current_rows") - F.col("shadow_rows"))
)

# documented patterns beside the engine
query("bucket_snapshot", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n, CAST(round(sum(o_totalprice), 1) AS DOUBLE) AS total FROM orders GROUP BY 1")(lambda s, d: orders(s, d).groupBy(heat.bucket_of(O).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total")))
query("snapshot_drift", "WITH n AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, count(*) AS n FROM orders WHERE o_orderkey % 1000 <> 3 GROUP BY 1) SELECT bucket, coalesce(s.n, 0) AS snapshot_rows, coalesce(n.n, 0) AS live_rows FROM n FULL JOIN s USING (bucket) WHERE n.n IS DISTINCT FROM s.n")(
    lambda s, d: heat.heatmap(orders(s, d), heat.bucket_of(O)).withColumnRenamed("n", "live_rows").join(heat.heatmap(orders(s, d).where("o_orderkey % 1000 <> 3"), heat.bucket_of(O)).withColumnRenamed("n", "snapshot_rows"), "bucket", "full_outer")
    .where(~F.col("live_rows").eqNullSafe(F.col("snapshot_rows"))).select("bucket", F.coalesce("snapshot_rows", F.lit(0).cast("long")).alias("snapshot_rows"), F.coalesce("live_rows", F.lit(0).cast("long")).alias("live_rows"))
)
query("parent_oriented_lookup", "SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 1 month")(
    lambda s, d: orders(s, d).join(lineitem(s, d), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 1 MONTH"))).select("o_orderkey", "l_linenumber", "l_shipdate")
)
query("run_summary", f"SELECT 'orders' AS table_name, substr(sha256('[' || string_agg(r, ',' ORDER BY r) || ']'), 1, 16) AS plan_signature, CAST(0 AS BIGINT) AS rows_moved, false AS skipped FROM (SELECT '[\"' || name || '\",\"' || range_start || '\",\"' || range_end || '\",\"' || kind || '\"]' AS r FROM ({_SEG_O}))")(lambda s, d: s.createDataFrame([((r := _maintained(s, d, O_DAY)[0].run_table(O)).table_name, r.plan_signature, r.rows_moved, r.skipped)], "table_name string, plan_signature string, rows_moved long, skipped boolean"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A full maintenance run over orders: the children and their rows after it."""
    return _maintained(spark, d, O_DAY)[1].children_df("orders")
