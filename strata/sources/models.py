"""Materialization of model outputs: view, table, incremental (append, merge, delete+insert) or nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.incremental import append, rewrite
from strata.warehouse.scd import ACTION, upsert

MATERIALIZATIONS = ("table", "view", "incremental", "ephemeral")
STRATEGIES = ("append", "merge", "delete+insert")


@dataclass(frozen=True)
class ModelConfig:
    materialized: str = "view"
    strategy: str = "append"
    unique_key: Sequence[str] = ()
    partition_by: Sequence[str] = ()
    cluster_by: Sequence[str] = ()


def delete_insert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the target rows whose keys come again, then add all source rows."""
    incoming = source.select(*[F.col(k).alias(f"__{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    return target.join(incoming, condition, "left_anti").unionByName(source)


def materialize(df: DataFrame, name: str, config: ModelConfig, base_path: str) -> DataFrame:
    """Store a model's output and return what later models should read."""
    spark = df.sparkSession
    if config.materialized not in MATERIALIZATIONS:
        raise ValueError(f"materialized must be one of {MATERIALIZATIONS}")
    if config.materialized == "ephemeral":
        return df
    if config.materialized == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    path = f"{base_path.rstrip('/')}/{name}"

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions(*config.cluster_by) if config.cluster_by else rows

    parts = list(config.partition_by)
    if config.materialized == "table":
        result = rewrite(spark, path, lambda _: shaped(df), parts)
    elif config.strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    elif config.strategy == "append":
        result = append(spark, path, shaped(df), parts)
    else:
        if not config.unique_key:
            raise ValueError(f"strategy {config.strategy!r} needs unique_key")

        def change(current: DataFrame | None) -> DataFrame:
            if current is None:
                return shaped(df)
            if config.strategy == "merge":
                return shaped(upsert(current, df, config.unique_key).drop(ACTION))
            return shaped(delete_insert(current, df, config.unique_key))

        result = rewrite(spark, path, change, parts)
    result.createOrReplaceTempView(name)
    return result
