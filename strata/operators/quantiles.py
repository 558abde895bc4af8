"""Exact medians without holding all values of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.windows import HOT_ROWS, window


def exact_median(df: DataFrame, group_by: Sequence[str], column: str, name: str = "median", hot_rows: int = HOT_ROWS, few_groups: bool = False) -> DataFrame:
    """Median per group: equal values are counted first, then ranks are found with a running count.

    The running count is split over many tasks when a group has very many distinct values. Nulls are
    left out. The mean of the middle two is taken for an even number of values. Without groups, or with
    ``few_groups`` (as many as a table has columns), the totals are so few rows that each task gets them all, and the
    values stay where they are.
    """
    groups = list(group_by) or ["__all"]
    source = df if group_by else df.withColumn("__all", F.lit(1))
    counted = source.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("__k"))
    running = window(counted, groups, [column], {"__upto": {"function": "running_sum", "column": "__k"}}, [], hot_rows)
    totals = counted.groupBy(*groups).agg(F.sum("__k").alias("__total"))
    a, b = running.alias("a"), (totals if group_by and not few_groups else F.broadcast(totals)).alias("b")
    condition = F.lit(True)
    for g in groups:
        condition = condition & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    upto, below = F.col("__upto"), F.col("__upto") - F.col("__k")
    low, high = F.ceil(F.col("__total") / 2), F.floor(F.col("__total") / 2) + 1
    middle = a.join(b, condition).where((upto >= low) & (below < high))
    value = F.col(f"a.{column}").cast("double")
    result = middle.groupBy(*[F.col(f"a.{g}").alias(g) for g in groups]).agg(
        ((F.min(F.when((below < low) & (upto >= low), value)) + F.max(F.when((below < high) & (upto >= high), value))) / 2).alias(name)
    )
    return result if group_by else result.drop("__all")
