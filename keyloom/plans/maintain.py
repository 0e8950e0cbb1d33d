"""The maintenance pipeline: audit, default, rebalance, archive, retention, drain; one atomic commit for each table.

Rebalance, archive finalisation and default drain are one move here: rows of every child that changes, and of default, are
routed to their target child, written as a new generation, and committed with the new bounds. An interrupted run leaves
the last manifest; running again is the resume.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators.heat import bucket_of, heatmap, key_of
from ..operators.move import MissingConflictKey, delta_window, to_sync, upserted
from ..operators.route import route
from ..sources.catalog import Catalog, LockNotAcquired, merged
from . import diff
from .config import Registry, TableConfig
from .layout import ARCHIVE, DEFAULT, HOT, active_window, branch_children, build_plan
from .model import AuditResult, Plan, PlanReport, RunMetrics, RunSummary, Segment, shown


class RunFailed(RuntimeError):
    """Some tables failed; `summary` tells which."""

    def __init__(self, summary: RunSummary):
        super().__init__("; ".join(summary.errors))
        self.summary = summary


class Maintenance:
    def __init__(self, catalog: Catalog, today: date, notify: Callable[[str, dict], None] = lambda message, context: None):
        self.catalog, self.today, self.notify = catalog, today, notify

    def create(self, config: TableConfig, rows: DataFrame) -> None:
        """Registers a dataset and puts all rows into its default child (hash layouts: routed at once)."""
        self.catalog.register(config.table_name, rows.schema, config.partition_key_column)
        name = f"{config.table_name}_{DEFAULT}"
        self._commit(config, rows.withColumn("child", F.lit(name)), {name: Segment(name, None, None, DEFAULT)}, keep={}, signature=None, based=self.catalog.manifest(config.table_name))

    # planning
    def counts(self, config: TableConfig) -> tuple[dict, dict]:
        """(bucket -> rows, bucket -> rows of its dedicated child), from one aggregation.

        Only children that hold several buckets and may change are read: default, fillers and future. Archives are not, and the
        rows of a child with one bucket stand in the manifest.
        """
        if config.layout == "list_split":
            return {}, {}
        children = self.catalog.manifest(config.table_name)["children"]
        sized = self._sized(config)
        if config.layout == "hash_branches":
            dedicated = {s.start["remainder"]: n for s, n in sized if isinstance(s.start, dict)}
        else:
            dedicated = {s.start: n for s, n in sized if s.kind == HOT}
        mixed = [n for n, c in children.items() if c["rows"] and c["kind"] not in (HOT, ARCHIVE)]
        if not mixed:
            return {}, dedicated
        found = heatmap(self.catalog.read(config.table_name, children=mixed), bucket_of(config)).collect()  # a row for each bucket
        lo = active_window(config, self.today)[0]
        return {r.bucket: r.n for r in found if r.bucket is not None and (isinstance(lo, int) or r.bucket >= lo)}, dedicated

    def _sized(self, config: TableConfig) -> list[tuple[Segment, int]]:
        rows = self.catalog.manifest(config.table_name)["children"]
        return [(s, rows[s.name]["rows"]) for s in self.catalog.attached(config.table_name)]

    def plan(self, config: TableConfig) -> Plan:
        return build_plan(config, self.today, *self.counts(config))

    def tail(self, config: TableConfig) -> list[Segment]:
        """Attached children that the layout manages; archives are not among them."""
        return [s for s in self.catalog.attached(config.table_name) if s.kind != ARCHIVE or isinstance(s.start, dict)]

    def report(self, config: TableConfig) -> PlanReport:
        return diff.report(config, self.plan(config), self.tail(config), self.today)

    def audit(self, config: TableConfig) -> AuditResult:
        if not self.catalog.exists(config.table_name):
            return diff.audit(config, None, None, self.today)
        default = self.catalog.manifest(config.table_name)["children"].get(f"{config.table_name}_{DEFAULT}")
        out = diff.audit(config, self.catalog.attached(config.table_name), default and default["rows"], self.today)
        if orphans := self.catalog.orphans(config.table_name):
            out.warnings.append(f"{len(orphans)} generations that no manifest names")
        return out

    # applying
    def _commit(self, config: TableConfig, routed: DataFrame, targets: dict[str, Segment], keep: dict, signature: str | None, based: dict) -> int:
        """Writes the routed rows and commits on the manifest that they were read from."""
        t = config.table_name
        stats = self.catalog.write_rows(t, routed)
        children = dict(keep)
        for name in stats.keys() | targets.keys():
            segment = targets.get(name) or self._archive(config, name)
            entry = self.catalog.child_entry(segment, stats.get(name), default=segment.kind == DEFAULT)
            if name in children:  # rows that join a child kept as it is
                entry = merged(children[name], entry, self.catalog.key_type(based))
            children[name] = entry
        if config.needs_default:
            d = f"{t}_{DEFAULT}"
            children.setdefault(d, self.catalog.child_entry(Segment(d, None, None, DEFAULT), None, default=True))
        self.catalog.commit(t, based | {"children": children, "signature": signature}, based["version"])
        return sum(s["rows"] for s in stats.values())

    def _archive(self, config: TableConfig, name: str) -> Segment:
        if name == f"{config.table_name}_{DEFAULT}" or (config.child is not None and name.endswith(f"_{DEFAULT}")):
            return Segment(name, None, None, DEFAULT)
        if config.child is None and config.is_date and (b := cal.parse_child(config.table_name, name, config.bucket)):
            return Segment(name, b, cal.next_bucket(b, config.bucket), ARCHIVE)
        if config.layout == "integer_window" and "_ids_" in name:
            lo, hi = (int(x) for x in name.rsplit("_ids_", 1)[1].split("_"))
            return Segment(name, lo, hi, ARCHIVE)
        return Segment(name, None, None, ARCHIVE)

    def rebalance(self, config: TableConfig) -> tuple[int, str, bool]:
        """(rows moved, plan signature, changed). Children that stay as they are keep their files."""
        t = config.table_name
        m = self.catalog.manifest(t)
        self.require_columns(config, m)
        inner: dict = {}
        if config.child is None:
            plan = self.plan(config)
        else:
            plan, parents, inner = self.composite_plan(config)
        target = [s for s in plan.segments if config.maintenance_backend != "layout_only" or s.name in m["children"]]
        ops = diff.operations(self.tail(config), target)
        waiting = sum(c["rows"] for c in m["children"].values() if c.get("default"))
        changed = any(o.action != "keep" for o in ops)
        settled = m.get("signature") == plan.signature()
        if not changed and (not waiting or settled):
            return 0, plan.signature(), False
        same = {o.segment.name for o in ops if o.action == "keep"} if config.incremental_rebalance else set()
        tail = {s.name for s in self.tail(config)}
        moving = [n for n, c in m["children"].items() if (n in tail and n not in same) or c.get("default")]
        keep = {n: c for n, c in m["children"].items() if n not in moving}
        for s in target:
            if s.name in keep:
                keep[s.name] = keep[s.name] | {"kind": s.kind}
        rows = self.catalog.read(t, children=moving, version=m["version"])
        targets = {s.name: s for s in target if s.name not in keep}
        routed = route(rows, config, target, self.today) if config.child is None else route(rows, config, parents, self.today, inner)
        n = self._commit(config, routed, targets, keep, plan.signature(), m)
        self.notify("moved", {"table": t, "rows": n, "archived": sorted(set(self.catalog.manifest(t)["children"]) - set(m["children"]) - {s.name for s in target})})
        return n, plan.signature(), True

    def require_columns(self, config: TableConfig, manifest: dict) -> None:
        """The partition key and the conflict key must be columns of the table: without them moves can't tell rows apart."""
        have = {f["name"] for f in json.loads(manifest["schema"])["fields"]}
        missing = [c for c in {config.partition_key_column, *config.conflict_key} if c not in have]
        if missing:
            raise MissingConflictKey(f"{config.table_name} has no column {', '.join(sorted(missing))}")

    def composite_plan(self, config: TableConfig) -> tuple[Plan, list[Segment], dict]:
        """The plan over both levels, the segments of the first, and for each of these its inner layout and segments.

        Hot buckets are found on both levels: for the inner one from one aggregation by first-level child and inner bucket.
        """
        t, outer = config.table_name, replace(config, child=None)
        m = self.catalog.manifest(t)
        mixed = [n for n, c in m["children"].items() if c["rows"] and (c["kind"] != ARCHIVE or isinstance(c["start"], dict))]
        rows = self.catalog.read(t, children=mixed, version=m["version"])
        counts = {} if outer.layout == "list_split" else {r.bucket: r.n for r in heatmap(rows, bucket_of(outer)).collect() if r.bucket is not None}
        parents = list(build_plan(outer, self.today, counts).segments)
        moduli = {name: b["modulus"] for name, b in branch_children(outer) if "modulus" in b}
        layouts = {p.name: replace(config.child, table_name=p.name, parent=t, modulus=moduli.get(p.name, config.child.modulus)) for p in parents}
        found: dict[str, dict] = {name: {} for name in layouts}
        if config.child.layout != "list_split":
            bucket = F.lit(None)
            for name, c in layouts.items():
                bucket = F.when(F.col("child") == name, bucket_of(c)).otherwise(bucket)
            for r in heatmap(route(rows, outer, parents, self.today), bucket, "child").collect():  # a row for each bucket of each child
                if r.child in found and r.bucket is not None:
                    found[r.child][r.bucket] = r.n
        inner = {name: (c, list(build_plan(c, self.today, found[name]).segments)) for name, c in layouts.items()}
        both = [
            Segment(s.name, {"parent": [shown(p.start), shown(p.end)], "child": [shown(s.start), shown(s.end)]}, None, s.kind) for p in parents for s in inner[p.name][1]
        ]
        return Plan(tuple(both)), parents, inner

    def premake(self, config: TableConfig) -> list[str]:
        """Empty children from this month to premake_months ahead, where no child covers them; then default's rows that have a child go there."""
        t, made = config.table_name, []
        m = self.catalog.manifest(t)
        covered = [s for s in self.catalog.attached(t, m["version"]) if isinstance(s.start, date)]
        for i in range(config.premake_months + 1):
            b = cal.add_months(self.today, i)
            name = cal.child_name(t, b, "month")
            if name not in m["children"] and not any(s.start < cal.add_months(b, 1) and (not isinstance(s.end, date) or b < s.end) for s in covered):
                m["children"][name] = self.catalog.child_entry(Segment(name, b, cal.add_months(b, 1), HOT), None)
                made.append(name)
        default = m["children"].get(f"{t}_{DEFAULT}")
        if default and default["rows"]:
            self._drain(config, m, changed=bool(made))
        elif made:
            self.catalog.commit(t, m, m["version"])
        return made

    def ensure_future(self, config: TableConfig, months_ahead: int = 1) -> list[str]:
        """The months that a cutover's shadow needs before it takes live rows; more than three ahead are notified."""
        if months_ahead > 3:
            self.notify("many_months_ahead", {"table": config.table_name, "months": months_ahead})
        return self.premake(replace(config, premake_months=months_ahead))

    def sync(self, source: str, config: TableConfig, stale: str | None, months: int = 3, derived: dict | None = None) -> int:
        """Brings config's table up to the dataset `source` within the months around today: rows that it lacks are added, older ones
        (by `stale`) replaced, in one commit. Returns how many.

        If the conflict key holds the partition key, only children that can hold a row of the delta are rewritten. Rows that no
        child takes go to default. Layouts whose key isn't a date are compared whole.
        """
        t, key = config.table_name, list(config.conflict_key)
        m, default = self.catalog.manifest(t), f"{config.table_name}_{DEFAULT}"
        window = delta_window(self.today, months) if config.is_date else None
        rows = self.catalog.read(source, key_range=window)
        for name, value in (derived or {}).items():
            rows = rows.withColumn(name, value)
        keyed = config.partition_key_column in key
        near = self.catalog.meeting(t, *window) if keyed and window else list(m["children"])
        delta = to_sync(rows, self.catalog.read(t, children=near, version=m["version"]), key, stale).persist()
        try:
            attached = {s.name: s for s in self.catalog.attached(t, m["version"])}
            routed = lambda df: route(df, config, list(attached.values()), self.today).withColumn("child", F.when(F.col("child").isin(list(attached)), F.col("child")).otherwise(F.lit(default)))
            landing = {r.child: r.n for r in routed(delta).groupBy("child").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each child
            if not landing:
                return 0
            moving = [n for n in near if not keyed or n in landing or m["children"][n].get("default")]
            after = upserted(delta, self.catalog.read(t, children=moving, version=m["version"]), key, stale)
            targets = {n: attached.get(n) or Segment(n, None, None, DEFAULT) for n in moving}
            self._commit(config, routed(after), targets, {n: c for n, c in m["children"].items() if n not in moving}, None, m)
            return sum(landing.values())
        finally:
            delta.unpersist()

    def _drain(self, config: TableConfig, m: dict, changed: bool) -> int:
        """Moves default's rows into the attached children that take their keys; commits if that or `changed` alters anything."""
        t, name = config.table_name, f"{config.table_name}_{DEFAULT}"
        segments = [Segment(n, date.fromisoformat(c["start"]["date"]) if isinstance(c["start"], dict) else c["start"], date.fromisoformat(c["end"]["date"]) if isinstance(c["end"], dict) else c["end"], c["kind"]) for n, c in m["children"].items() if isinstance(c["start"], (dict, date))]
        key, child = key_of(config), F.lit(name)
        for s in segments:
            child = F.when((key >= F.lit(s.start)) & (key < F.lit(s.end)), F.lit(s.name)).otherwise(child)
        routed = self.catalog.read(t, children=[name], version=m["version"]).withColumn("child", child)
        if routed.where(F.col("child") != name).isEmpty():
            if changed:
                self.catalog.commit(t, m, m["version"])
            return 0
        keep = {n: c for n, c in m["children"].items() if n != name}
        return self._commit(config, routed, {name: Segment(name, None, None, DEFAULT)}, keep, m.get("signature"), m)

    def compact(self, config: TableConfig, over: int = 8) -> list[str]:
        """Rewrites children that lie in more than `over` generations, as streaming ingest leaves them, into one each."""
        m = self.catalog.manifest(config.table_name)
        many = [n for n, c in m["children"].items() if len(c["paths"]) > over]
        for name in many:
            stats = self.catalog.write_rows(config.table_name, self.catalog.read(config.table_name, children=[name], version=m["version"]).withColumn("child", F.lit(name)))
            m["children"][name] |= stats[name]
        if many:
            self.catalog.commit(config.table_name, m, m["version"])
        return many

    def retention(self, config: TableConfig) -> list[str]:
        """Children whose bucket is older than the month-aligned cutoff; dropped or detached if retention_apply, else only named."""
        if not config.retention_months or not config.is_date:
            return []
        cutoff = cal.add_months(self.today, -config.retention_months)
        m = self.catalog.manifest(config.table_name)
        old = [s.name for s in self.catalog.attached(config.table_name) if s.kind == ARCHIVE and isinstance(s.start, date) and s.start < cutoff]
        self.notify("retention", {"table": config.table_name, "children": len(old), "applied": config.retention_apply})
        if old and config.retention_apply:
            for name in old:
                entry = m["children"].pop(name)
                if config.retention_keep_table:
                    m["detached"][name] = entry
            self.catalog.commit(config.table_name, m, m["version"])
        return old

    def run_table(self, config: TableConfig) -> RunMetrics:
        began, out = time.monotonic(), RunMetrics(config.table_name)
        if not self.catalog.exists(config.table_name):
            return RunMetrics(config.table_name, skipped=True, skip_reason="not_partitioned")
        if config.maintenance_backend == "external":
            return RunMetrics(config.table_name, skipped=True, skip_reason="external_owner")
        phase = "audit"
        try:
            for w in self.audit(config).warnings:
                self.notify(w, {"table": config.table_name})
            phase = "rebalance"
            if config.layout == "premake_monthly":
                self.premake(config)
            else:
                out.rows_moved, out.plan_signature, _ = self.rebalance(config)
            phase = "retention"
            if config.maintenance_backend == "engine":
                self.retention(config)
            phase = "done"
        except LockNotAcquired:
            return RunMetrics(config.table_name, skipped=True, skip_reason="lock_not_acquired")
        finally:
            out.duration_ms = int(1000 * (time.monotonic() - began))
            self.catalog.record_run(config.table_name, {"today": self.today.isoformat(), "phase": phase, "rows_moved": out.rows_moved, "plan_signature": out.plan_signature, "duration_ms": out.duration_ms})
        return out

    split_future = split_pressured = collapse_low_volume = rebalance

    def run(self, registry: Registry, table: str | None = None, continue_on_error: bool = False) -> RunSummary:
        summary = RunSummary()
        for config in registry if table is None else filter(None, [registry.find(table)]):  # a composite is maintained as one table
            try:
                summary.tables.append(self.run_table(config))
            except Exception as e:
                summary.errors.append(f"{config.table_name}: {e}")
                self.notify(str(e), {"table": config.table_name})
                if not continue_on_error:
                    break
        if summary.errors:
            raise RunFailed(summary)
        return summary
