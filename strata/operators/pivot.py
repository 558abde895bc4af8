"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions._cols import named, quoted
from strata.operators.aggregate import metric

MAX_PIVOT_VALUES = 10_000


def pivot_values(df: DataFrame, column: str) -> list[Any]:
    """Sorted distinct values that become columns; refused when there are too many to be columns."""
    rows = df.select(named(column)).where(named(column).isNotNull()).distinct().limit(MAX_PIVOT_VALUES + 1).collect()
    if len(rows) > MAX_PIVOT_VALUES:
        raise ValueError(f"column {column!r} has more than {MAX_PIVOT_VALUES} values; take pivot_long")
    return sorted(r[0] for r in rows)


def pivot(
    df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "sum",
    pivot_on: Sequence[Any] | None = None, order_by: Sequence[str] = (),
) -> DataFrame:
    """Wide table with one ``<columns>_<value>`` column per value.

    Rows whose pivot value or measure is null are left out first, so an index that has no others
    disappears. An absent cell is 0 for sums and counts and null otherwise.
    """
    kept = df.where(named(columns).isNotNull() & named(values).isNotNull())
    wanted = pivot_values(kept, columns) if pivot_on is None else list(pivot_on)
    cell = metric(kept, {"column": values, "function": aggfunc}, order_by)
    # Spark names the columns itself, so they are taken by place: a value may hold any character
    wide = kept.groupBy(*[named(c) for c in index]).pivot(quoted(columns), wanted).agg(cell.alias("cell"))
    wide = wide.toDF(*index, *[f"__cell{i}" for i in range(len(wanted))])
    zero = {"sum": F.lit(0.0), "count": F.lit(0), "count_distinct": F.lit(0)}.get(aggfunc)
    out = [named(c) for c in index]
    for i, value in enumerate(wanted):
        column = F.col(f"__cell{i}")
        out.append((column if zero is None else F.coalesce(column, zero)).alias(f"{columns}_{value}"))
    return wide.select(*out)


def pivot_long(df: DataFrame, index: Sequence[str], columns: str, values: str, aggfunc: str = "sum", order_by: Sequence[str] = ()) -> DataFrame:
    """The cells of :func:`pivot` as rows (index, ``columns``, cell), for any number of values; absent cells have no row."""
    kept = df.where(named(columns).isNotNull() & named(values).isNotNull())
    return kept.groupBy(*[named(c) for c in [*index, columns]]).agg(metric(kept, {"column": values, "function": aggfunc}, order_by).alias("cell"))


def pivot_rows(df: DataFrame, group_by: str, pivot_column: str, value_column: str, agg_func: str = "sum", pivot_on: Sequence[Any] | None = None) -> DataFrame:
    """Pivot that keeps everything: a null pivot value makes a ``_None`` column, counts and averages include nulls."""
    wanted = pivot_values(df, pivot_column) if pivot_on is None else [v for v in pivot_on if v is not None]
    # The columns are written as conditional aggregates, so that the null value can be one of them.
    with_null = (None in pivot_on) if pivot_on is not None else not df.where(F.col(pivot_column).isNull()).isEmpty()
    value, out = F.col(value_column), []
    for v in [*wanted, *([None] if with_null else [])]:
        here = F.col(pivot_column).eqNullSafe(F.lit(v))
        total, rows = F.coalesce(F.sum(F.when(here, value)).cast("double"), F.lit(0.0)), F.count_if(here)
        cells = {"sum": total, "count": rows, "avg": F.when(rows > 0, total / rows).otherwise(0.0)}
        if agg_func not in cells:
            raise ValueError(f"unknown aggregation {agg_func!r}")
        out.append(cells[agg_func].alias(f"{pivot_column}_{v}"))
    return df.groupBy(group_by).agg(*out)


def unpivot_columns(df: DataFrame, id_columns: Sequence[str], value_columns: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row per listed column; null values keep their row."""
    return df.unpivot(list(id_columns), list(value_columns), var_name, value_name)
