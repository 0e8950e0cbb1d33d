"""Bucket calendar: day, ISO week, month, quarter, year. Python functions for planning, Column twins for data."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: bucket: (active-span key, default span, date_trunc unit)
BUCKETS = {
    "day": ("active_days", 90, "day"),
    "week": ("active_weeks", 52, "week"),
    "month": ("active_months", 12, "month"),
    "quarter": ("active_quarters", 8, "quarter"),
    "year": ("active_years", 2, "year"),
}
_SUFFIX = {
    "day": r"(\d{4})_(\d{2})_(\d{2})",
    "week": r"(\d{4})_W(\d{2})",
    "month": r"(\d{4})_(\d{2})",
    "quarter": r"(\d{4})_Q([1-4])",
    "year": r"(\d{4})",
}


def normalize(bucket: str | None) -> str:
    """A known bucket name; anything else is month."""
    return bucket if bucket in BUCKETS else "month"


def to_date(value: date | datetime | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def bucket_start(value: date | str, bucket: str) -> date:
    d, bucket = to_date(value), normalize(bucket)
    if bucket == "day":
        return d
    if bucket == "week":
        return d - timedelta(days=d.weekday())
    if bucket == "year":
        return date(d.year, 1, 1)
    return date(d.year, (d.month - 1) // 3 * 3 + 1 if bucket == "quarter" else d.month, 1)


def add_months(value: date | str, n: int) -> date:
    """n months after the first of value's month."""
    d = to_date(value)
    m = d.year * 12 + d.month - 1 + n
    return date(m // 12, m % 12 + 1, 1)


def add_buckets(value: date | str, n: int, bucket: str) -> date:
    d, bucket = to_date(value), normalize(bucket)
    if bucket in ("day", "week"):
        return d + timedelta(days=n * (7 if bucket == "week" else 1))
    if bucket == "year":
        return date(d.year + n, d.month, d.day)
    return add_months(d, n * (3 if bucket == "quarter" else 1))


def next_bucket(value: date | str, bucket: str) -> date:
    return add_buckets(bucket_start(value, bucket), 1, bucket)


def buckets_between(start: date, end: date, bucket: str) -> list[date]:
    out, at = [], bucket_start(start, bucket)
    while at < end:
        out.append(at)
        at = next_bucket(at, bucket)
    return out


def suffix(value: date | str, bucket: str) -> str:
    d, bucket = bucket_start(value, bucket), normalize(bucket)
    if bucket == "week":
        iso = d.isocalendar()
        return f"{iso.year:04d}_W{iso.week:02d}"
    return {"day": f"{d:%Y_%m_%d}", "month": f"{d:%Y_%m}", "quarter": f"{d.year:04d}_Q{(d.month + 2) // 3}", "year": f"{d:%Y}"}[bucket]


def child_name(table: str, value: date | str, bucket: str) -> str:
    return f"{table}_{suffix(value, bucket)}"


def parse_child(table: str, name: str, bucket: str) -> date | None:
    """The bucket that a child's name stands for, or None."""
    bucket = normalize(bucket)
    m = re.fullmatch(re.escape(table) + "_" + _SUFFIX[bucket], name)
    if not m:
        return None
    parts = [int(x) for x in m.groups()]
    try:
        if bucket == "week":
            return date.fromisocalendar(parts[0], parts[1], 1)
        if bucket == "quarter":
            return date(parts[0], 3 * parts[1] - 2, 1)
        return date(*(parts + [1, 1])[:3])
    except ValueError:
        return None


def trunc_col(key: Column, bucket: str) -> Column:
    return F.date_trunc(BUCKETS[normalize(bucket)][2], key).cast("date")


def next_col(start: Column, bucket: str) -> Column:
    """The bucket after one that starts at `start`."""
    bucket = normalize(bucket)
    if bucket in ("day", "week"):
        return F.date_add(start, 7 if bucket == "week" else 1)
    return F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[bucket])


def suffix_col(start: Column, bucket: str) -> Column:
    bucket = normalize(bucket)
    year = F.date_format(start, "yyyy")
    return {
        "day": F.date_format(start, "yyyy_MM_dd"),
        "week": F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), 4, "0"), F.lit("_W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0")),
        "month": F.date_format(start, "yyyy_MM"),
        "quarter": F.concat(year, F.lit("_Q"), F.quarter(start).cast("string")),
        "year": year,
    }[bucket]


def parse_col(name: Column, table: str, bucket: str) -> Column:
    bucket = normalize(bucket)
    pattern = f"^{table}_{_SUFFIX[bucket]}$"
    part = lambda i: F.regexp_extract(name, pattern, i).try_cast("int")
    if bucket == "week":
        first = F.date_trunc("week", F.make_date(part(1), F.lit(1), F.lit(4))).cast("date")
        return F.date_add(first, (part(2) - 1) * 7)
    month = {"day": part(2) if bucket == "day" else None, "month": part(2) if bucket == "month" else None, "quarter": 3 * part(2) - 2 if bucket == "quarter" else None, "year": F.lit(1)}[bucket]
    return F.make_date(part(1), month, part(3) if bucket == "day" else F.lit(1))
