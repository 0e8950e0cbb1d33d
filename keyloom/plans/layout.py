"""Active windows and target segments, on the driver: their number follows the window, not the data."""

from __future__ import annotations

from datetime import date

from ..functions import calendar as cal
from .config import TableConfig
from .model import MAX, Plan, Segment

FILLER, FUTURE, HOT, ARCHIVE, BRANCH = "filler", "future", "hot_bucket", "archive", "branch"
CURRENT, OPEN, AHEAD, DEFAULT = "current", "open", "future", "default"


def active_window(config: TableConfig, today: date) -> tuple:
    if config.is_date:
        start = cal.bucket_start(today, config.bucket)
        return start, cal.add_buckets(start, config.span, config.bucket)
    if config.layout == "integer_window":
        return config.active_id_lo, config.active_id_lo + config.active_id_width
    return (0, config.modulus) if config.layout == "hash_branches" else (None, None)


def window_buckets(config: TableConfig, today: date) -> list[tuple]:
    """(start, end) of the window's buckets; the last integer band ends with the window."""
    lo, hi = active_window(config, today)
    if config.is_date:
        return [(b, cal.next_bucket(b, config.bucket)) for b in cal.buckets_between(lo, hi, config.bucket)]
    return [(b, min(b + config.current_band_size, hi)) for b in range(lo, hi, config.current_band_size)]


def bucket_child(config: TableConfig, start, end) -> str:
    if config.namer:
        return config.namer(start)
    if config.is_date:
        return cal.child_name(config.table_name, start, config.bucket)
    return f"{config.table_name}_ids_{start}_{end}"


def branch_children(config: TableConfig) -> list[tuple[str, dict]]:
    return [(f"{config.table_name}_{b['name']}", b) for b in config.branches]


def segments(config: TableConfig, today: date, hot: set) -> list[Segment]:
    """The target children: runs of cold buckets as fillers, hot buckets alone, and one open end."""
    t = config.table_name
    if config.layout == "hash_branches":
        return [Segment(f"{t}_{'h' if r in hot else 'a'}_{r:02d}", {"modulus": config.modulus, "remainder": r}, None, HOT if r in hot else ARCHIVE) for r in range(config.modulus)]
    if config.layout == "list_split":
        return [Segment(name, b.get("value"), None, BRANCH) for name, b in branch_children(config)]
    lo, hi = active_window(config, today)
    runs: list[list] = []
    for start, end in window_buckets(config, today):
        if start in hot:
            runs.append([HOT, start, end])
        elif runs and runs[-1][0] == FILLER:
            runs[-1][2] = end
        else:
            runs.append([FILLER, start, end])
    out, opened = [], 0
    for kind, start, end in runs:
        if kind == HOT:
            name = bucket_child(config, start, end)
        elif start == lo:
            name = f"{t}_{CURRENT}"
        else:
            opened += 1
            name = f"{t}_{OPEN}" + (f"_{opened}" if opened > 1 else "")
        out.append(Segment(name, start, end, kind))
    return [*out, Segment(f"{t}_{AHEAD}", hi, MAX, FUTURE)]


def select_hot(config: TableConfig, counts: dict, dedicated: dict | None = None) -> set:
    """Buckets at or over the threshold; a bucket with a child of its own is judged by that child's rows."""
    if config.layout in ("rolling_current", "list_split", "premake_monthly"):
        return set()
    return {b for b, n in {**counts, **(dedicated or {})}.items() if b is not None and n >= config.threshold}


def build_plan(config: TableConfig, today: date, counts: dict, dedicated: dict | None = None) -> Plan:
    hot = select_hot(config, counts, dedicated)
    if config.layout not in ("hash_branches", "list_split"):
        hot &= {s for s, _ in window_buckets(config, today)}
    return Plan(tuple(segments(config, today, hot)), tuple(sorted(hot)))


def bound_clause(segment: Segment) -> str:
    """The bound in declarative-partition notation."""
    s, e = segment.start, segment.end
    if segment.kind == BRANCH:
        return f"FOR VALUES IN ({_quoted(s)})"
    if isinstance(s, dict):
        return f"FOR VALUES WITH (modulus {s['modulus']}, remainder {s['remainder']})"
    return f"FOR VALUES FROM ({_quoted(s)}) TO ({'MAXVALUE' if e == MAX else _quoted(e)})"


def _quoted(v: object) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def parse_bound(text: str) -> dict:
    """The inverse of bound_clause: default, hash, list or range."""
    import re

    if text.strip() == "DEFAULT":
        return {"default": True}
    if m := re.search(r"modulus (\d+), remainder (\d+)", text):
        return {"modulus": int(m[1]), "remainder": int(m[2])}
    value = lambda v: None if v == "NULL" else MAX if v == "MAXVALUE" else int(v) if re.fullmatch(r"-?\d+", v) else (date.fromisoformat(v[1:11]) if re.fullmatch(r"'\d{4}-\d\d-\d\d.*'", v) else v.strip("'").replace("''", "'"))
    if m := re.search(r"IN \((.*)\)$", text):
        return {"values": [value(v) for v in re.findall(r"NULL|'(?:[^']|'')*'|-?\d+", m[1])]}
    m = re.search(r"FROM \((.*)\) TO \((.*)\)$", text)
    if not m:
        raise ValueError(f"no bound: {text}")
    return {"start": value(m[1]), "end": value(m[2])}
