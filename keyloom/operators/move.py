"""De-duplicating moves, keyset pages, uniqueness, conditional upserts. All set-based: one job instead of a batch loop."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_months


class MissingConflictKey(RuntimeError):
    """The conflict key is not unique."""


def violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n) of the keys that occur more than once; keys with a null never conflict."""
    present = rows.where(_all_present(key))
    return present.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: list[str]) -> None:
    if violations(rows, key).limit(1).count():
        raise MissingConflictKey(f"{', '.join(key)} is not unique")


def _all_present(key: list[str]) -> Column:
    out = F.lit(True)
    for c in key:
        out &= F.col(c).isNotNull()
    return out


def first_of_key(batch: DataFrame, key: list[str], cursor: list[str]) -> DataFrame:
    """The first row by cursor of each key; every row whose key has a null."""
    null_key = batch.where(~_all_present(key))
    w = Window.partitionBy(*key).orderBy(*cursor)
    first = batch.where(_all_present(key)).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return first.unionByName(null_key)


def fresh_rows(batch: DataFrame, dest: DataFrame, key: list[str], cursor: list[str]) -> DataFrame:
    """What a conflict-free insert of batch adds to dest."""
    return first_of_key(batch, key, cursor).join(dest.select(*key), key, "left_anti")


def duplicates(batch: DataFrame, dest: DataFrame, key: list[str]) -> DataFrame:
    return batch.join(dest.select(*key), key, "left_semi")


def moved(source: DataFrame, dest: DataFrame, where: Column, key: list[str], cursor: list[str]) -> tuple[DataFrame, DataFrame]:
    """(source, dest) after moving source's rows where the condition is true."""
    batch = source.where(where)
    return source.where(~F.coalesce(where, F.lit(False))), dest.unionByName(fresh_rows(batch, dest, key, cursor))


def move_stats(source: DataFrame, dest: DataFrame, where: Column, key: list[str], cursor: list[str]) -> DataFrame:
    """One row: batch_size, inserted, duplicates, and the last cursor's fields."""
    batch = source.where(where)
    total = batch.agg(F.count(F.lit(1)).alias("batch_size"), F.max(F.struct(*cursor)).alias("last"))
    inserted = fresh_rows(batch, dest, key, cursor).agg(F.count(F.lit(1)).alias("inserted"))
    both = total.crossJoin(F.broadcast(inserted))  # one row each
    return both.select("batch_size", "inserted", (F.col("batch_size") - F.col("inserted")).alias("duplicates"), *(F.col(f"last.{c}").alias(f"last_{c}") for c in cursor))


def after(cursor: list[str], values: tuple) -> Column:
    """The row-value comparison (cursor) > (values)."""
    return F.struct(*cursor) > F.struct(*(F.lit(v).alias(c) for c, v in zip(cursor, values)))


def keyset_page(rows: DataFrame, cursor: list[str], values: tuple | None, size: int) -> DataFrame:
    page = rows if values is None else rows.where(after(cursor, values))
    return page.orderBy(*cursor).limit(size)


def last_cursor(page: DataFrame, cursor: list[str]) -> DataFrame:
    last = page.agg(F.max(F.struct(*cursor)).alias("last"))
    return last.select(*(F.col(f"last.{c}").alias(c) for c in cursor))


def delta_window(today: date, months: int = 3) -> tuple[date, date]:
    """From the first of the month so many months back to the first of the month so many ahead."""
    return add_months(today, -months), add_months(today, months)


def to_sync(source: DataFrame, target: DataFrame, key: list[str], stale: str | None, within: Column | None = None) -> DataFrame:
    """Source rows that target lacks, or holds with an older `stale` column."""
    rows = source if within is None else source.where(within)
    t = target.select(*(F.col(c).alias(f"__{c}") for c in {*key, *([stale] if stale else [])}))
    on = F.lit(True)
    for c in key:
        on &= F.col(c) == F.col(f"__{c}")
    if stale:
        on &= F.col(f"__{stale}") >= F.col(stale)
    return rows.join(t, on, "left_anti")


def upserted(source: DataFrame, target: DataFrame, key: list[str], stale: str | None, within: Column | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """target after inserting what it lacks and updating what is older; only columns that both have, and derived ones, change."""
    for name, value in (derived or {}).items():
        source = source.withColumn(name, value)
    common = [c for c in target.columns if c in source.columns]
    delta = first_of_key(to_sync(source, target, key, stale, within), key, [stale or key[0], *key])
    d = delta.select(*(F.col(c).alias(f"__d_{c}") for c in common), F.lit(True).alias("__hit"))
    on = F.lit(True)
    for c in key:
        on &= F.col(c) == F.col(f"__d_{c}")
    joined = target.join(d, on, "full_outer")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__d_{c}")).otherwise(F.col(c)).alias(c) if c in common else F.col(c) for c in target.columns))
