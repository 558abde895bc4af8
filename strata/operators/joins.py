"""Lookup and aggregate-then-join helpers.

No side is ever broadcast by hint: Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, splitting hot keys at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.dedup import deduplicate


def lookup(df: DataFrame, field: str, table: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """Add ``<field>_lookup`` from a key/value table; an unknown key gives null."""
    pairs = deduplicate(table.select(F.col(key).alias("__key"), F.col(value).alias(name or f"{field}_lookup")).where(F.col("__key").isNotNull()), ["__key"], keep="last")
    return df.join(pairs, df[field] == pairs["__key"], "left").drop("__key")


def join_aggregated(base: DataFrame, detail: DataFrame, base_key: str, detail_key: str, metrics: Mapping[str, Column], zeros: Mapping[str, object]) -> DataFrame:
    """Left join of per-key totals; ``zeros`` fills the metrics of keys without detail rows."""
    totals = detail.groupBy(F.col(detail_key).alias("__key")).agg(*[m.alias(n) for n, m in metrics.items()])
    joined = base.join(totals, base[base_key] == totals["__key"], "left").drop("__key")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(z)) for n, z in zeros.items()})


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key is not in the parent table."""
    keys = parent.select(F.col(parent_key).alias("__parent"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__parent"), "left_anti")


def existing(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are already in the target; null keys never match."""
    return df.join(target.select(*keys), list(keys), "left_semi")


def missing(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(target.select(*keys), list(keys), "left_anti")
