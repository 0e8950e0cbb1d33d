"""Table configurations, their builders, composite layouts, and the registry with its JSON form."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import date

from ..functions.calendar import BUCKETS, normalize

DEFAULT_THRESHOLD = 100_000
LAYOUTS = ("sliding_window", "rolling_current", "calendar_year", "premake_monthly", "integer_window", "hash_branches", "list_split")
OWNERS = ("engine", "external", "layout_only")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class TableConfig:
    table_name: str
    layout: str
    partition_key_column: str
    conflict_key: tuple[str, ...]
    bucket: str = "month"
    active_span: int | None = None
    split_row_threshold: int | None = None
    retention_months: int | None = None
    retention_apply: bool = False
    retention_keep_table: bool = False
    premake_months: int = 3
    active_id_lo: int = 0
    active_id_width: int = 10_000_000
    current_band_size: int = 1_000_000
    archive_band_size: int = 10_000_000
    modulus: int = 32
    branches: tuple[dict, ...] = ()
    incremental_rebalance: bool = True
    maintenance_backend: str = "engine"
    parent: str | None = None
    #: For composites: the layout inside each branch.
    child: "TableConfig | None" = None
    key_transform: str | None = None  # "date" for a timestamp key
    namer: Callable[[object], str] | None = field(default=None, compare=False)

    @property
    def threshold(self) -> int:
        return DEFAULT_THRESHOLD if self.split_row_threshold is None else self.split_row_threshold

    @property
    def span(self) -> int:
        return self.active_span or BUCKETS[normalize(self.bucket)][1]

    @property
    def cursor(self) -> tuple[str, ...]:
        """Ordering columns: the key, then the rest of the conflict key."""
        return (self.partition_key_column, *(c for c in self.conflict_key if c != self.partition_key_column))

    @property
    def is_date(self) -> bool:
        return self.layout in ("sliding_window", "rolling_current", "calendar_year", "premake_monthly")

    @property
    def needs_default(self) -> bool:
        return self.layout != "hash_branches"


def _table(name: str, layout: str, key: str, conflict: tuple[str, ...] | list[str] | None, **more) -> TableConfig:
    return TableConfig(name, layout, key, tuple(conflict or (key, "id")), **more)


def sliding_monthly(name: str, key: str, conflict=None, active_months: int = 12, **more) -> TableConfig:
    return _table(name, "sliding_window", key, conflict, bucket="month", active_span=active_months, **more)


def sliding_daily(name: str, key: str, conflict=None, active_days: int = 90, **more) -> TableConfig:
    return _table(name, "sliding_window", key, conflict, bucket="day", active_span=active_days, **more)


def sliding_weekly(name: str, key: str, conflict=None, active_weeks: int = 52, **more) -> TableConfig:
    return _table(name, "sliding_window", key, conflict, bucket="week", active_span=active_weeks, **more)


def sliding_quarterly(name: str, key: str, conflict=None, active_quarters: int = 8, **more) -> TableConfig:
    return _table(name, "sliding_window", key, conflict, bucket="quarter", active_span=active_quarters, **more)


def rolling_current(name: str, key: str, conflict=None, bucket: str = "month", **more) -> TableConfig:
    """A sliding window that never splits a bucket."""
    return _table(name, "rolling_current", key, conflict, bucket=bucket, **more)


def premake_monthly(name: str, key: str, conflict=None, premake_months: int = 3, **more) -> TableConfig:
    return _table(name, "premake_monthly", key, conflict, premake_months=premake_months, **more)


def calendar_year(name: str, key: str, conflict=None, active_years: int = 2, **more) -> TableConfig:
    return _table(name, "calendar_year", key, conflict, bucket="year", active_span=active_years, **more)


def integer_window(name: str, key: str = "id", conflict=None, **more) -> TableConfig:
    return _table(name, "integer_window", key, conflict or (key,), **more)


def hash_branches(name: str, key: str, conflict=None, modulus: int = 32, **more) -> TableConfig:
    return _table(name, "hash_branches", key, conflict, modulus=modulus, **more)


def list_split(name: str, key: str, branches, conflict=None, **more) -> TableConfig:
    """branches: values, or dicts with name and value or predicate."""
    rows = tuple(b if isinstance(b, dict) else {"name": str(b), "value": b} for b in branches)
    return _table(name, "list_split", key, conflict, branches=rows, **more)


def composite(parent: TableConfig, child: TableConfig) -> TableConfig:
    """parent's branches, each laid out by child; a child without a conflict key of its own takes the parent's."""
    return replace(parent, child=replace(child, conflict_key=child.conflict_key or parent.conflict_key))


def composite_list_hash(name: str, key: str, branches, child_key: str, modulus: int = 32, conflict=None, **more) -> TableConfig:
    return composite(list_split(name, key, branches, conflict), hash_branches(name, child_key, conflict, modulus, **more))


def composite_list_range(name: str, key: str, branches, child_key: str, conflict=None, **more) -> TableConfig:
    return composite(list_split(name, key, branches, conflict), sliding_monthly(name, child_key, conflict, **more))


list_range = composite_list_range


def composite_range_hash(name: str, key: str, child_key: str, modulus: int = 32, conflict=None, **more) -> TableConfig:
    return composite(sliding_monthly(name, key, conflict, **more), hash_branches(name, child_key, conflict, modulus))


def composite_range_list(name: str, key: str, child_key: str, branches, conflict=None, **more) -> TableConfig:
    return composite(sliding_monthly(name, key, conflict, **more), list_split(name, child_key, branches, conflict))


TEMPLATES = {f.__name__: f for f in (sliding_monthly, sliding_daily, sliding_weekly, sliding_quarterly, rolling_current, premake_monthly, calendar_year, integer_window, hash_branches, list_split, composite_list_hash, composite_list_range, composite_range_hash, composite_range_list)}
TEMPLATES["list_range"] = composite_list_range


def expand(config: TableConfig) -> list[TableConfig]:
    """A composite as its parent and one node for each list branch; other tables as they are."""
    if config.child is None:
        return [config]
    nodes = [replace(config, child=None)]
    for b in config.branches:
        nodes.append(replace(config.child, table_name=f"{config.table_name}_{b['name']}", parent=config.table_name, modulus=b.get("modulus", config.child.modulus)))
    return nodes


_SPANS = {key: bucket for bucket, (key, _, _) in BUCKETS.items()}
_LIMITS = {"active_days": (1, 366), "active_weeks": (1, 104), "active_months": (1, 36), "active_quarters": (1, 20), "active_years": (1, 10), "premake_months": (0, 24), "modulus": (2, 128)}
_PLAIN = {f.name for f in fields(TableConfig)} - {"child", "parent", "namer", "active_span", "branches"}
_KEYS = _PLAIN | set(_SPANS) | {"branches"}


def from_document(doc: dict) -> TableConfig:
    """A configuration from its JSON object; raises ConfigError on what is missing, unknown or out of range."""
    missing = [k for k in ("table_name", "layout", "partition_key_column", "conflict_key") if not doc.get(k)]
    if missing:
        raise ConfigError(f"missing: {', '.join(missing)}")
    if unknown := sorted(set(doc) - _KEYS):
        raise ConfigError(f"unknown keys: {', '.join(unknown)}")
    if doc["layout"] not in LAYOUTS:
        raise ConfigError(f"unsupported layout: {doc['layout']}")
    for k in ("table_name", "partition_key_column"):
        if not isinstance(doc[k], str) or not _NAME.match(doc[k]):
            raise ConfigError(f"{k} must be a name")
    key = doc["conflict_key"]
    if not isinstance(key, list) or not all(isinstance(c, str) and c for c in key):
        raise ConfigError("conflict_key must be a list of names")
    if doc.get("bucket", "month") not in BUCKETS:
        raise ConfigError(f"unsupported bucket: {doc['bucket']}")
    if doc.get("maintenance_backend", "engine") not in OWNERS:
        raise ConfigError(f"unsupported maintenance_backend: {doc['maintenance_backend']}")
    for k, (lo, hi) in _LIMITS.items():
        if k in doc and not (isinstance(doc[k], int) and lo <= doc[k] <= hi):
            raise ConfigError(f"{k} must be from {lo} to {hi}")
    known = {k: v for k, v in doc.items() if k in _PLAIN}
    known["conflict_key"] = tuple(key)
    span = next((k for k in _SPANS if k in doc), None)
    if span:
        known["active_span"] = doc[span]
        known.setdefault("bucket", _SPANS[span])
    if doc["layout"] == "calendar_year":
        known["bucket"] = "year"
    if "branches" in doc:
        known["branches"] = tuple(b if isinstance(b, dict) else {"name": str(b), "value": b} for b in doc["branches"])
    return TableConfig(**known)


def to_document(config: TableConfig) -> dict:
    """The portable keys that differ from their defaults."""
    plain = TableConfig(config.table_name, config.layout, config.partition_key_column, config.conflict_key)
    out = {k: v for k, v in asdict(replace(config, child=None, namer=None)).items() if k in _PLAIN and (k in ("table_name", "layout", "partition_key_column", "conflict_key") or v != getattr(plain, k))}
    out["conflict_key"] = list(config.conflict_key)
    if config.active_span:
        out[BUCKETS[normalize(config.bucket)][0]] = config.active_span
    if config.branches:
        out["branches"] = [dict(b) for b in config.branches]
    return out


class Registry:
    """Tables by name; registering a name again replaces it. Ownership mismatches raise if strict, else are reported."""

    def __init__(self, strict: bool = False, notify: Callable[[str], None] = lambda message: None):
        self._tables: dict[str, TableConfig] = {}
        self.strict, self.notify = strict, notify

    def __iter__(self) -> Iterator[TableConfig]:
        return iter(self._tables.values())

    def register(self, config: TableConfig) -> TableConfig:
        message = None
        if config.maintenance_backend == "external" and config.layout != "premake_monthly":
            message = f"{config.table_name}: an external owner runs no layout of this engine"
        elif config.maintenance_backend == "layout_only" and config.retention_apply:
            message = f"{config.table_name}: layout_only leaves retention to the external owner"
        elif config.maintenance_backend == "layout_only" and config.layout == "premake_monthly":
            message = f"{config.table_name}: layout_only leaves premaking to the external owner"
        if message and self.strict:
            raise ConfigError(message)
        if message:
            self.notify(message)
        self._tables[config.table_name] = config
        return config

    def find(self, name: str) -> TableConfig | None:
        return self._tables.get(name)

    def configs_for(self, name: str | None = None) -> list[TableConfig]:
        """The nodes of one table, or of all; a composite answers for its parent's name."""
        chosen = self if name is None else [c for c in self if c.table_name == name]
        return [n for c in chosen for n in expand(c)]

    def load(self, text: str) -> list[TableConfig]:
        """Registers a JSON array, a single object, or {"tables": [...]}."""
        doc = json.loads(text)
        rows = doc.get("tables", [doc]) if isinstance(doc, dict) else doc
        return [self.register(c) for c in [from_document(r) for r in rows]]

    def export(self) -> str:
        return json.dumps([to_document(c) for c in self])

    def cutover_months(self, today: date) -> list[date]:
        from ..functions.calendar import add_months

        return [add_months(today, 0), add_months(today, 1)]
