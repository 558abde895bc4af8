"""Incremental scans with a stored high-water mark, and versioned tables for rewritten data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def last_mark(spark: SparkSession, mark_path: str, kind: T.DataType) -> str | None:
    """Highest saved mark (compared in its own type, given as text), or None before the first run."""
    if not exists(spark, mark_path):
        return None
    marks = spark.read.schema(T.StructType([T.StructField("mark", kind)])).parquet(mark_path)
    return marks.agg(F.max("mark").cast("string")).first()[0]


def new_rows(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows strictly after the mark (a filter that reaches the scan); all rows without a mark."""
    return df if mark is None else df.where(F.col(column) > _literal(df, column, mark))


def _literal(df: DataFrame, column: str, text: str) -> Column:
    return F.lit(text).cast(df.schema[column].dataType)


def load_increment(df: DataFrame, column: str, mark_path: str, sink: Callable[[DataFrame], None], unmarked: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Hand new rows to the sink, then save the new mark.

    Rows with a null mark cannot be told old from new and never move the mark. All of them go to
    ``unmarked`` on every run, to replace what it holds; without it, to the sink on every run. The upper bound is fixed before the load, so rows that arrive meanwhile wait for the next one. The
    mark is saved after the sink has succeeded, so a failed run is repeated from the same place.
    """
    spark, kind = df.sparkSession, df.schema[column].dataType
    mark = last_mark(spark, mark_path, kind)
    fresh = new_rows(df, column, mark).where(F.col(column).isNotNull())
    without = df.where(F.col(column).isNull())
    highest = fresh.agg(F.max(column).cast("string")).first()[0]
    if highest is not None:
        fresh = fresh.where(F.col(column) <= _literal(df, column, highest))
    if unmarked:
        unmarked(without)
    else:
        fresh = fresh.unionByName(without)
    sink(fresh)
    if highest is not None:
        saved = spark.range(1).select(F.lit(highest).cast(kind).alias("mark"))
        saved.write.mode("append").parquet(mark_path)
    return fresh


def next_version(spark: SparkSession, base_path: str) -> tuple[str | None, str]:
    """(current, next) folder of a table kept as ``v=1``, ``v=2`` …; a version is complete once it has its success mark."""
    number, current = 0, None
    while exists(spark, f"{base_path}/v={number + 1}/_SUCCESS"):
        number += 1
        current = f"{base_path}/v={number}"
    return current, f"{base_path}/v={number + 1}"


def rewrite(spark: SparkSession, base_path: str, change: Callable[[DataFrame | None], DataFrame], partition_by: Sequence[str] = ()) -> DataFrame:
    """Write the changed table as its next version; readers of the current one are not disturbed."""
    current, target = next_version(spark, base_path)
    rows = change(None if current is None else spark.read.parquet(current))
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.parquet(target)


def append(spark: SparkSession, base_path: str, rows: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Add files to the current version (the first one when there is none); nothing is rewritten."""
    current, first = next_version(spark, base_path)
    rows.write.mode("append").partitionBy(*partition_by).parquet(current or first)
    return spark.read.parquet(current or first)
