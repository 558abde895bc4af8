"""Incremental loads of sources without a mark: rows whose key no earlier load has brought.

A load leaves its keys and a filter of their hashes, a table of bitmaps. The next load tests its rows against the
merged bitmaps, which have a fixed size at most and are broadcast; a row whose bit is not set is new for certain
and is never shuffled. The others, known rows and chance hits, meet the keys in an exact anti-join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import quoted
from strata.sources.incremental import exists

#: Bits of one bitmap (Spark's own size, 4 KB) and bitmaps of a filter: 32 MB at most.
PAGE, PAGES = 32_768, 8_192


def _place(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(PAGE * PAGES))


def _filter(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``page, bits`` of the pages that have a bit set."""
    placed = rows.select(_place(keys).alias("place")).select(F.expr(f"place div {PAGE}").alias("page"), (F.col("place") % PAGE).alias("bit"))
    return placed.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def loads(spark: SparkSession, path: str) -> int:
    """Number of complete loads."""
    number = 0
    while exists(spark, f"{path}/load={number + 1}/bits/_SUCCESS"):
        number += 1
    return number


def split_new(df: DataFrame, keys: Sequence[str], path: str, number: int) -> tuple[DataFrame, DataFrame]:
    """(rows that the filter calls new, rows that may be known) after ``number`` loads."""
    spark = df.sparkSession
    bits = spark.read.schema("page bigint, bits binary").parquet(*[f"{path}/load={k}/bits" for k in range(1, number + 1)])
    merged = bits.groupBy("page").agg(F.bitmap_or_agg("bits").alias("__bits")).withColumnRenamed("page", "__page")
    placed = df.withColumn("__place", _place(keys))
    tested = placed.join(F.broadcast(merged), F.expr(f"__place div {PAGE}") == F.col("__page"), "left")
    bit = F.col("__place") % PAGE
    byte = F.conv(F.hex(F.substring("__bits", (F.expr(f"(__place % {PAGE}) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce((F.expr("shiftright(__byte, __bit)") % 2) == 1, F.lit(False))
    tested = tested.withColumns({"__byte": byte, "__bit": (bit % 8).cast("int")}).withColumn("__set", is_set)
    kept = [F.col(quoted(c)) for c in df.columns]
    return tested.where("NOT __set").select(*kept), tested.where("__set").select(*kept)


def load_new_keys(df: DataFrame, keys: Sequence[str], path: str, sink: Callable[[DataFrame], None]) -> None:
    """Hand the rows with unknown keys to the sink, then note their keys under ``path``.

    Null parts of a key compare equal to null. All rows of a new key go together, repeated ones too. The load
    counts as complete with its filter, which is written last: one that failed is repeated from the same place,
    so the sink must replace what a failed attempt has left.
    """
    spark, number = df.sparkSession, loads(df.sparkSession, path)
    fresh = df
    if number:
        new, maybe = split_new(df, keys, path, number)
        schema = T.StructType([T.StructField(f"__k{i}", df.schema[k].dataType) for i, k in enumerate(keys)])
        known = spark.read.schema(schema).parquet(*[f"{path}/load={k}/keys" for k in range(1, number + 1)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(quoted(k)).eqNullSafe(F.col(f"__k{i}"))
        fresh = new.unionByName(maybe.join(known, same, "left_anti"))
    target = f"{path}/load={number + 1}"
    sink(fresh)
    named = [F.col(quoted(k)).alias(f"__k{i}") for i, k in enumerate(keys)]
    fresh.select(*named).distinct().write.mode("overwrite").parquet(f"{target}/keys")
    saved = spark.read.parquet(f"{target}/keys")
    _filter(saved, saved.columns).write.mode("overwrite").parquet(f"{target}/bits")
