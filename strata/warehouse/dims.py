"""Date and time dimensions and the mapping of source rows to dimension columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.dates import fiscal_quarter, fiscal_year

# Default range of the date dimension and grain of the time dimension.
DEFAULT_START, DEFAULT_END = "2020-01-01", "2025-12-31"
DEFAULT_GRAIN = 15


def date_columns(days: DataFrame, day: str = "date_actual") -> DataFrame:
    """Calendar columns of a table of days; weeks start on Monday (0), fiscal years in July."""
    d = F.col(day)
    return days.select(
        "date_sk", d,
        F.weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_number"),
        F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "MMM").alias("month_name_short"),
        F.quarter(d).alias("quarter"), F.year(d).alias("year"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        (F.weekday(d) >= 5).alias("is_weekend"), F.lit(False).alias("is_holiday"),
        fiscal_year(d).alias("fiscal_year"), fiscal_quarter(d).alias("fiscal_quarter"),
    )


def date_dimension(spark: SparkSession, start: str = DEFAULT_START, end: str = DEFAULT_END) -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("lo"), F.lit(end).cast("date").alias("hi"))
    return _days(bounds)


def date_dimension_of(df: DataFrame, column: str) -> DataFrame:
    """Date dimension that spans the dates found in a table."""
    day = F.col(column).cast("date")
    return _days(df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where(F.col("lo").isNotNull()))


def _days(bounds: DataFrame) -> DataFrame:
    days = bounds.select("lo", F.explode(F.sequence("lo", "hi")).alias("date_actual"))
    return date_columns(days.select((F.datediff("date_actual", "lo") + 1).cast("bigint").alias("date_sk"), "date_actual"))


def time_dimension(spark: SparkSession, grain_minutes: int = DEFAULT_GRAIN) -> DataFrame:
    """One row per grain step of each hour."""
    if not 1 <= grain_minutes <= 60:
        raise ValueError("grain_minutes must be between 1 and 60")
    per_hour = -(-60 // grain_minutes)
    slots = spark.range(24 * per_hour, numPartitions=1).select(
        (F.col("id") + 1).alias("time_sk"),
        F.floor(F.col("id") / per_hour).cast("int").alias("hour"),
        (F.col("id") % per_hour * grain_minutes).cast("int").alias("minute"),
    )
    hour = F.col("hour")
    return slots.select(
        "time_sk", F.format_string("%02d:%02d:00", "hour", "minute").alias("time_actual"), "hour", "minute", F.lit(0).alias("second"),
        F.when(hour % 12 == 0, 12).otherwise(hour % 12).alias("hour_12"), F.when(hour < 12, "AM").otherwise("PM").alias("am_pm"),
        F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening").alias("time_of_day"),
        ((hour >= 9) & (hour < 17)).alias("is_business_hours"),
    )


def map_columns(source: DataFrame, columns: Sequence[str], mapping: Mapping[str, str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Select ``"name type"`` columns from a source: by mapped name, else by default value, else null."""
    mapping, defaults, out = mapping or {}, defaults or {}, []
    for item in columns:
        name, kind = item.split()
        source_name = mapping.get(name, name)
        value = F.col(source_name) if source_name in source.columns else F.lit(defaults.get(name))
        out.append(value.cast(kind).alias(name))
    return source.select(*out)
