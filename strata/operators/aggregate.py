"""Grouped metrics described by plain data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.predicates import filter_condition, having_condition

FUNCTIONS = ("count", "count_distinct", "sum", "avg", "min", "max", "first", "last", "std")


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, T.DecimalType) else F.col(name).try_cast("double")


def _all_numeric(df: DataFrame, name: str, value: Column) -> Column:
    """A text that is no number makes the whole group's result null, as one bad value spoils the sum."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return value
    bad = F.count_if(F.col(name).isNotNull() & F.col(name).try_cast("double").isNull())
    return F.when(bad == 0, value)


def metric(df: DataFrame, spec: Mapping[str, Any], order_by: Sequence[str] = ()) -> Column:
    """Aggregate Column of one ``{"column", "function"}`` entry; decimals are summed exactly.

    ``count`` counts rows. ``first`` and ``last`` take the non-null value at the lowest or highest
    ``order_by`` position (the value itself breaks ties).
    """
    function, name = spec.get("function", "count"), spec.get("column")
    if function == "count":
        return F.count(F.lit(1))
    if function == "count_distinct":
        if spec.get("approximate"):
            return F.approx_count_distinct(name)
        return F.count_distinct(name)
    if function == "sum":
        return _all_numeric(df, name, F.coalesce(F.sum(_number(df, name)).cast("double"), F.lit(0.0)))
    if function == "avg":
        return _all_numeric(df, name, F.avg(_number(df, name)).cast("double"))
    if function == "std":
        return _all_numeric(df, name, F.stddev_samp(_number(df, name)))
    if function == "min":
        return F.min(name)
    if function == "max":
        return F.max(name)
    if function in ("first", "last"):
        if not order_by:
            raise ValueError(f"{function} needs order_by")
        place = F.when(F.col(name).isNotNull(), F.struct(*order_by, name))
        return F.min_by(name, place) if function == "first" else F.max_by(name, place)
    raise ValueError(f"unknown aggregate function {function!r}; known: {FUNCTIONS}")


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    metrics: Mapping[str, Mapping[str, Any]],
    filters: Mapping[str, Any] | None = None,
    having: Mapping[str, Mapping[str, Any]] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Filter, group, aggregate, filter again. Null keys form a group; no keys over no rows give no row."""
    source = df.where(filter_condition(filters, df.schema)) if filters else df
    columns = [metric(source, spec, order_by).alias(name) for name, spec in metrics.items()]
    if group_by:
        result = source.groupBy(*group_by).agg(*columns)
    else:
        result = source.agg(*columns, F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > 0).drop("__rows")
    return result.where(having_condition(having)) if having else result


def aggregate_step(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Pipeline form: counts non-null values, empty sums and averages are 0, no keys leaves the input unchanged."""
    if not group_by:
        return df
    columns = []
    for name, spec in aggregations.items():
        source, function = spec["column"], spec["function"]
        value = {
            "sum": lambda: F.coalesce(F.sum(_number(df, source)).cast("double"), F.lit(0.0)),
            "avg": lambda: F.coalesce(F.avg(_number(df, source)).cast("double"), F.lit(0.0)),
            "count": lambda: F.count(source),
            "min": lambda: F.min(source),
            "max": lambda: F.max(source),
        }.get(function)
        if value is None:
            raise ValueError(f"unknown aggregation {function!r}")
        columns.append(value().alias(name))
    return df.groupBy(*group_by).agg(*columns)


def distribution(df: DataFrame, column: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Rows per value; a column the table does not have counts as ``unknown``, a null stays null."""
    value = F.col(column).cast("string") if column in df.columns else F.lit(unknown)
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def share(condition: Column, digits: int = 4) -> Column:
    """Rounded share of rows that meet a condition; 0 over no rows."""
    rows = F.count(F.lit(1))
    return F.when(rows > 0, F.round(F.count_if(condition) / rows, digits)).otherwise(0.0)


def std_or_zero(value: Column) -> Column:
    """Sample deviation, 0 for a single value, null for none."""
    return F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0)


def weighted_mean(value: Column, weight: Column, default_weight: float = 3) -> Column:
    """Sum of value times weight over the sum of weights, which counts as 1 at least."""
    w = F.coalesce(weight, F.lit(default_weight))
    total = F.coalesce(F.sum(w), F.lit(0))
    return F.coalesce(F.sum(F.coalesce(value, F.lit(0)) * w), F.lit(0)).cast("double") / F.greatest(total, F.lit(1))


def mean_ratio(part: Column, whole: Column) -> Column:
    """Mean of the rows' own ratios; a missing whole is 1, one of 0 or less leaves the row out."""
    base = F.coalesce(whole, F.lit(1))
    return F.avg(F.when(base > 0, F.coalesce(part, F.lit(0)) / base))
