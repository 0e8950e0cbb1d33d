"""Structured predicates of list branches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_COLUMN = re.compile(r"[a-z_][a-z0-9_]*", re.I)
OPERATORS = ("eq", "ne", "is_null", "is_not_null")


class PredicateError(ValueError):
    pass


def column_of(predicate: dict) -> Column:
    """The condition of {column, operator, value}, with SQL's three-valued logic."""
    name, op = str(predicate.get("column", "")), str(predicate.get("operator", "eq"))
    if not _COLUMN.fullmatch(name):
        raise PredicateError(f"no column name: {name!r}")
    if op not in OPERATORS:
        raise PredicateError(f"unsupported operator: {op!r}")
    c, v = F.col(name), predicate.get("value")
    return {"eq": lambda: c == F.lit(v), "ne": lambda: c != F.lit(v), "is_null": c.isNull, "is_not_null": c.isNotNull}[op]()


def branch_condition(branch: dict, key: str | None) -> Column:
    """A branch's condition: its predicate, else its trusted SQL text, else equality of the key with its value."""
    if branch.get("predicate"):
        return column_of(branch["predicate"])
    if branch.get("where_condition"):
        return F.expr(branch["where_condition"])
    if key is not None and "value" in branch:
        return F.col(key).isNull() if branch["value"] is None else column_of({"column": key, "operator": "eq", "value": branch["value"]})
    raise PredicateError(f"branch {branch.get('name')!r} has neither predicate, where_condition nor value")
