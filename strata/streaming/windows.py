"""Time-window aggregates per key, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Window size and age after which a window is given up, in seconds.
WINDOW_SECONDS, MAX_AGE_SECONDS = 60, 300


def _numeric(df: DataFrame, value: str) -> Column:
    kind = df.schema[value].dataType
    return F.col(value) if isinstance(kind, T.DecimalType) else F.col(value).try_cast("double")


def windowed(df: DataFrame, key: str, value: str, timestamp: str, size_seconds: int = WINDOW_SECONDS, slide_seconds: int | None = None, max_age_seconds: int | None = None) -> DataFrame:
    """Count, sum and mean per key and window; windows are aligned with the epoch.

    Tumbling unless ``slide_seconds`` is given. The count includes values that are no numbers, and the
    mean divides by it. ``max_age_seconds`` sets the event-time watermark, which frees the state of old
    windows and drops rows that come later still. Every map task adds up its own rows first, so one
    very busy key sends one row per task and window.
    """
    timed = df.withColumn("__ts", F.col(timestamp).cast("timestamp"))
    if max_age_seconds is not None:
        timed = timed.withWatermark("__ts", f"{max_age_seconds} seconds")
    slot = F.window("__ts", f"{size_seconds} seconds", f"{slide_seconds} seconds" if slide_seconds else None)
    grouped = timed.groupBy(slot.alias("w"), F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(_numeric(df, value)), F.lit(0)).cast("double").alias("sum")
    )
    return grouped.select(
        "key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "sum", (F.col("sum") / F.col("count")).alias("avg")
    )


def window_values(df: DataFrame, key: str, value: str, timestamp: str, size_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The values behind each window as rows; a list per window would have no bound."""
    slot = F.window(F.col(timestamp).cast("timestamp"), f"{size_seconds} seconds")
    return df.select(F.col(key).alias("key"), slot["start"].alias("window_start"), F.col(timestamp).alias("timestamp"), F.col(value).alias("value"))


def window_at(aggregates: DataFrame, key: object, at: str) -> DataFrame:
    """The aggregate of one key whose window contains a point in time; no row when there is none."""
    moment = F.lit(at).cast("timestamp")
    return aggregates.where((F.col("key") == F.lit(key)) & (F.col("window_start") <= moment) & (moment < F.col("window_end")))


def drop_expired(aggregates: DataFrame, as_of: str, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Windows that started no more than ``max_age_seconds`` before a moment."""
    return aggregates.where(F.col("window_start") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS"))


def panes(df: DataFrame, key: str, value: str, timestamp: str, size_seconds: int, slide_seconds: int) -> DataFrame:
    """Count and sum per key and pane, the greatest step of which size and slide are multiples: each row counts once."""
    return windowed(df, key, value, timestamp, gcd(size_seconds, slide_seconds)).drop("avg")


def merged_panes(parts: DataFrame, size_seconds: int, slide_seconds: int) -> DataFrame:
    """Sliding windows from panes, of any number of parts: panes are added up first, then given to their windows.

    A pane of ``slide`` at most goes to ``size / slide`` windows; so many copies of one row for each key and pane,
    not of the rows behind it, reach the second shuffle.
    """
    step = gcd(size_seconds, slide_seconds)
    whole = merged(parts).withColumn("__at", F.unix_seconds("window_start"))
    last = F.floor(F.col("__at") / slide_seconds) * slide_seconds
    first = (F.floor((F.col("__at") + step - size_seconds - 1) / slide_seconds) + 1) * slide_seconds
    spread = whole.where(first <= last).select("key", F.explode(F.sequence(first, last, F.lit(slide_seconds).cast("long"))).alias("__start"), "count", "sum")
    out = spread.groupBy("key", "__start").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    times = [F.timestamp_seconds(F.col("__start") + shift).alias(name) for name, shift in (("window_start", 0), ("window_end", size_seconds))]
    return out.select("key", *times, "count", "sum", (F.col("sum") / F.col("count")).alias("avg"))


def in_time_and_late(key: str, value: str, timestamp: str, out: str, late: str, size_seconds: int = WINDOW_SECONDS, max_age_seconds: int = MAX_AGE_SECONDS, slide_seconds: int | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer for time windows that loses no row: parts go to ``out``, late rows whole to ``late``.

    Parts are those of tumbling windows, or of the panes of sliding ones if ``slide_seconds`` is given. A row is late if
    the last window that holds it ended ``max_age_seconds`` or more before the newest event of the earlier
    batches. Every batch writes its own folders and the newest event so far beside them, so a repeated batch
    changes nothing. :func:`merged` or :func:`merged_panes` add the parts up; rows without a time are late.
    """
    slide = slide_seconds or size_seconds

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        marks = f"{out.rstrip('/')}-marks"
        newest = spark.read.schema("newest timestamp").parquet(f"{marks}/batch={batch - 1}").first()[0] if batch else None
        timed = rows.withColumn("__ts", F.col(timestamp).cast("timestamp"))
        ends = F.timestamp_seconds(F.floor(F.unix_micros("__ts") / (slide * 1_000_000)) * slide + size_seconds)
        limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {int(max_age_seconds)} SECONDS")
        gone = F.col("__ts").isNull() | F.coalesce(ends <= limit, F.lit(False))
        timed.where(gone).drop("__ts").write.mode("overwrite").parquet(f"{late.rstrip('/')}/batch={batch}")
        parts = panes(timed.where(~gone).drop("__ts"), key, value, timestamp, size_seconds, slide)
        parts.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch}")
        timed.agg(F.greatest(F.max("__ts"), F.lit(newest).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")

    return write


def merged(parts: DataFrame) -> DataFrame:
    """Windows from the parts that the batches have written."""
    whole = parts.groupBy("key", "window_start", "window_end").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    return whole.withColumn("avg", F.col("sum") / F.col("count"))
