"""Small business rules used by the domain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import ColumnLike, as_col

# Lowest score of each grade.
GRADES = ((95, "A+"), (90, "A"), (85, "B+"), (80, "B"), (75, "C+"), (70, "C"), (60, "D"))
LOWEST_GRADE = "F"


def above(value: ColumnLike, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step that the value lies strictly above; steps are given highest first."""
    column, result = as_col(value), None
    for threshold, label in steps:
        condition = column > threshold
        result = F.when(condition, label) if result is None else result.when(condition, label)
    return result.otherwise(otherwise)


def categorize(value: ColumnLike, buckets: Sequence[tuple[float, str]]) -> Column:
    """Label of the last threshold reached (ascending buckets); below all of them the first label."""
    column = as_col(value)
    if not buckets:
        return F.lit("Unknown")
    result = F.when(column.isNull(), "Unknown")
    for threshold, label in reversed(list(buckets)):
        result = result.when(column >= threshold, label)
    return result.otherwise(buckets[0][1])


def letter_grade(score: ColumnLike) -> Column:
    column, result = as_col(score), None
    for lowest, grade in GRADES:
        result = F.when(column >= lowest, grade) if result is None else result.when(column >= lowest, grade)
    return result.otherwise(LOWEST_GRADE)


def range_flag(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """L/H outside the range, LL/HH beyond 0.8 of the low or 1.2 of the high bound, null inside."""
    v, lo, hi = as_col(value), as_col(low), as_col(high)
    low_flag = F.when(v < lo * 0.8, "LL").otherwise("L")
    high_flag = F.when(v > hi * 1.2, "HH").otherwise("H")
    return F.when(v < lo, low_flag).when(v > hi, high_flag)


def range_critical(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    return F.coalesce(range_flag(value, low, high).isin("LL", "HH"), F.lit(False))


def stream_range_critical(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    v, lo, hi = as_col(value), as_col(low), as_col(high)
    return F.coalesce((v < lo * 0.5) | (v > hi * 1.5), F.lit(False))


def outside_range(value: ColumnLike, low: ColumnLike, high: ColumnLike, flag: ColumnLike | None = None) -> Column:
    """True outside the bounds; a bound of 0 counts as absent, a missing value falls back to the flag."""
    v, lo, hi = as_col(value), as_col(low), as_col(high)
    fallback = F.lit(False) if flag is None else as_col(flag).isNotNull()
    below = F.coalesce((lo != 0) & (v < lo), F.lit(False))
    beyond = F.coalesce((hi != 0) & (v > hi), F.lit(False))
    return F.when(v.isNull(), fallback).otherwise(below | beyond)


def available_seats(capacity: ColumnLike, enrolled: ColumnLike) -> Column:
    cap, taken = as_col(capacity), F.coalesce(as_col(enrolled), F.lit(0))
    return F.when(cap.isNull() | (cap == 0), F.lit(0)).otherwise(F.greatest(F.lit(0), cap - taken))


def burn_rate(spent: ColumnLike, total: ColumnLike) -> Column:
    all_money = as_col(total)
    return F.when(all_money > 0, F.coalesce(as_col(spent), F.lit(0)) / all_money * 100)
