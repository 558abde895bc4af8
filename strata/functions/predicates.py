"""Predicates built from plain data: filters, having clauses and threshold rules."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import ColumnLike, as_col

COMPARE: dict[str, Callable[[Any, Any], Column]] = {
    "gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le, "eq": operator.eq, "ne": operator.ne,
}


def all_of(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions) if conditions else F.lit(True)


def comparable(kind: T.DataType | None, wanted: Any) -> bool:
    """False for a text against a number, either way round; such a comparison is no match and no error."""
    if kind is None or wanted is None:
        return True
    number = isinstance(wanted, (int, float, Decimal)) and not isinstance(wanted, bool)
    if isinstance(kind, T.StringType):
        return isinstance(wanted, str)
    if isinstance(kind, T.NumericType):
        return number or isinstance(wanted, bool)
    return not (isinstance(kind, T.BooleanType) and isinstance(wanted, str))


def matches(column: ColumnLike, wanted: Any, kind: T.DataType | None = None) -> Column:
    """One filter entry: a value (null-safe equality), a list of values, or a Column function.

    Meant for ``where``, which drops unknown outcomes by itself: written without a fallback, the
    comparison reaches the scan. With the column's type ``kind``, a text never equals a number.
    """
    value = as_col(column)
    if callable(wanted):
        return wanted(value)
    if isinstance(wanted, (list, tuple, set)):
        known = [w for w in wanted if w is not None and comparable(kind, w)]
        hit = value.isin(*known) if known else F.lit(False)
        return hit | value.isNull() if None in wanted else hit
    return value.eqNullSafe(F.lit(wanted)) if comparable(kind, wanted) else F.lit(False)


def filter_condition(filters: Mapping[str, Any], schema: T.StructType | None = None) -> Column:
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    return all_of([matches(name, wanted, kinds.get(name)) for name, wanted in filters.items()])


def threshold(value: ColumnLike, op: str, limit: Any) -> Column:
    """Comparison by name; null, and a value that is no number against a number, compare as false. An unknown operator is never true."""
    if op not in COMPARE:
        return F.lit(False)
    if isinstance(limit, (int, float)) and not isinstance(limit, bool):
        value = as_col(value).try_cast("double")
    return F.coalesce(COMPARE[op](as_col(value), limit if isinstance(limit, Column) else F.lit(limit)), F.lit(False))


def having_condition(having: Mapping[str, Mapping[str, Any]]) -> Column:
    """``{metric: {"operator", "value"}}``; a null metric fails, an unknown operator passes."""
    checks = []
    for metric, spec in having.items():
        op = spec.get("operator", "eq")
        value = as_col(metric)
        checks.append(COMPARE[op](value, F.lit(spec.get("value"))) if op in COMPARE else value.isNotNull())
    return all_of(checks)
