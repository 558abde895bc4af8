"""Database scans and sinks over JDBC. The driver jar of the database has to be on the class path."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from strata.operators.transforms import drop_internal, project_to, rename

WRITE_MODES = {"append": "append", "replace": "overwrite", "fail": "error"}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def bind(query: str, params: Mapping[str, object] | None) -> str:
    """Put literal values for ``:name`` marks; texts are quoted and their quotes doubled.

    The query is read once, so a value is never searched for marks; ``::`` and unknown names stay.
    """
    values = params or {}
    return re.sub(r"(?<!:):(\w+)", lambda m: _literal(values[m[1]]) if m[1] in values else m[0], query)


def scan_options(url: str, query: str, params: Mapping[str, object] | None = None, chunk_size: int = 10_000, partition: tuple[str, object, object, int] | None = None, driver: str | None = None) -> dict[str, str]:
    """Reader options; ``partition`` (column, lower, upper, number) makes the scan parallel."""
    options = {"url": url, "fetchsize": str(chunk_size)}
    bound = bind(query, params)
    if partition:
        column, lower, upper, number = partition
        # A partitioned scan needs a table expression instead of a query.
        options |= {"dbtable": f"({bound}) q", "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(number)}
    else:
        options["query"] = bound
    if driver:
        options["driver"] = driver
    return options


def read_database(spark: SparkSession, url: str, query: str, **kwargs: object) -> DataFrame:
    return spark.read.format("jdbc").options(**scan_options(url, query, **kwargs)).load()


def prepare(df: DataFrame, column_mapping: Mapping[str, str] | None = None, target_columns: Iterable[str] | None = None) -> DataFrame:
    """Rename, drop internal columns, keep the columns the target has."""
    rows = drop_internal(rename(df, column_mapping or {}))
    return rows if target_columns is None else project_to(rows, target_columns)


def write_database(df: DataFrame, url: str, table: str, schema: str | None = None, if_exists: str = "append", batch_size: int = 1000, column_mapping: Mapping[str, str] | None = None, target_columns: Iterable[str] | None = None, driver: str | None = None) -> None:
    """Append, replace (delete all rows, keep the table) or fail when the table exists."""
    if if_exists not in WRITE_MODES:
        raise ValueError(f"if_exists must be one of {tuple(WRITE_MODES)}")
    writer = prepare(df, column_mapping, target_columns).write.format("jdbc").option("url", url)
    writer = writer.option("dbtable", f"{schema}.{table}" if schema else table).option("batchsize", batch_size)
    if if_exists == "replace":
        writer = writer.option("truncate", True)
    if driver:
        writer = writer.option("driver", driver)
    writer.mode(WRITE_MODES[if_exists]).save()
