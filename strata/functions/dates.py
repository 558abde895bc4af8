"""Date functions. "Now" is always an argument, so that a job gives the same result when repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import ColumnLike, as_col

# Days per unit.
UNIT_DAYS = {"days": 1, "weeks": 7, "months": 30, "years": 365}
TRUNC_UNITS = ("year", "quarter", "month", "week")


def date_trunc(value: ColumnLike, unit: str) -> Column:
    """First day of the year, quarter, month or (Monday) week; any other unit gives the date itself."""
    day = as_col(value).cast("date")
    return F.trunc(day, unit) if unit in TRUNC_UNITS else day


def date_diff(start: ColumnLike, end: ColumnLike, unit: str = "days") -> Column:
    """Whole units from start to end, rounded down (toward minus infinity)."""
    days = F.datediff(as_col(end).cast("date"), as_col(start).cast("date"))
    return F.floor(days / UNIT_DAYS.get(unit, 1)).cast("bigint")


def completed_years(birth: ColumnLike, as_of: ColumnLike) -> Column:
    """Birthdays passed; someone born on 29 February has theirs on 1 March in other years."""
    born, day = as_col(birth).cast("date"), as_col(as_of).cast("date")
    before = (F.month(day) * 100 + F.day(day)) < (F.month(born) * 100 + F.day(born))
    return (F.year(day) - F.year(born) - before.cast("int")).cast("bigint")


def age_in_year_days(birth: ColumnLike, as_of: ColumnLike) -> Column:
    return date_diff(birth, as_of, "years")


def whole_days_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Full 24-hour days between two times, rounded down; null when either is null."""
    seconds = F.unix_micros(as_col(end).cast("timestamp")) - F.unix_micros(as_col(start).cast("timestamp"))
    return F.floor(seconds / 86_400_000_000).cast("bigint")


def whole_minutes_between(start: ColumnLike, end: ColumnLike) -> Column:
    micros = F.unix_micros(as_col(end).cast("timestamp")) - F.unix_micros(as_col(start).cast("timestamp"))
    return (micros / 60_000_000).cast("bigint")


def hours_between(start: ColumnLike, end: ColumnLike) -> Column:
    micros = F.unix_micros(as_col(end).cast("timestamp")) - F.unix_micros(as_col(start).cast("timestamp"))
    return micros / 3_600_000_000


def fiscal_year(day: ColumnLike) -> Column:
    """The fiscal year starts in July."""
    column = as_col(day)
    return F.when(F.month(column) >= 7, F.year(column)).otherwise(F.year(column) - 1)


def fiscal_quarter(day: ColumnLike) -> Column:
    return (F.floor(F.pmod(F.month(as_col(day)) - 7, F.lit(12)) / 3) + 1).cast("int")
