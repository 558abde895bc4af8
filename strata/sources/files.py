"""File scans and file sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.transforms import drop_internal, rename


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, delimiter: str = ",", encoding: str = "UTF-8", column_mapping: Mapping[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column a string; ``columns`` picks columns by their name in the header.

    An empty field is null. Files of a folder must have the same header: one with other columns, or the same in
    another order, ends the scan instead of filling the wrong columns. Large files are split between tasks. Only where
    quoted values hold line breaks, ask for ``multi_line``, which makes each file one task.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("inferSchema", False)
    reader = reader.option("multiLine", multi_line).option("escape", '"').option("enforceSchema", False)
    rows = reader.csv(path)
    if columns:
        rows = rows.select(*[F.col(f"`{c}`") for c in columns])
    return rename(rows, column_mapping or {})


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, records_path: str | None = None, multi_line: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """JSON documents; ``records_path`` is a dotted path to the array (or object) that holds the records."""
    reader = spark.read.option("multiLine", multi_line).option("encoding", encoding)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if not records_path:
        return df
    target = df.select(F.col(records_path).alias("r"))
    if isinstance(target.schema["r"].dataType, T.ArrayType):
        target = target.select(F.explode("r").alias("r"))
    return target.select("r.*") if isinstance(target.schema["r"].dataType, T.StructType) else target.select(F.col("r").alias("value"))


def read_batches(spark: SparkSession, directory: str, schema: T.StructType | str, files_per_batch: int = 1, delimiter: str = ",") -> DataFrame:
    """CSV folder as a stream of bounded batches; run it with the ``availableNow`` trigger.

    A file whose header differs from the schema ends the stream instead of filling the wrong columns.
    """
    return (
        spark.readStream.schema(schema).option("header", True).option("sep", delimiter).option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch).csv(directory)
    )


def read_domain(spark: SparkSession, base_path: str, schemas: Mapping[str, T.StructType | str | None]) -> dict[str, DataFrame]:
    """The JSON tables of a domain folder, one per entity name."""
    return {name: read_json(spark, f"{base_path.rstrip('/')}/{name}.json", schema, multi_line=False) for name, schema in schemas.items()}


def scan_summary(df: DataFrame) -> DataFrame:
    """Source files and sizes behind a scan, for the run report."""
    meta = df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
    return meta.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("records"))


FORMATS = ("csv", "json", "jsonl", "parquet")


def write_files(df: DataFrame, path: str, file_format: str = "csv", append: bool = False, encoding: str = "UTF-8", compression: str | None = None) -> None:
    """Write without the internal (``_``) columns. JSON is always written anew, as one object per line; JSON files may be compressed."""
    if file_format not in FORMATS:
        raise ValueError(f"unsupported format {file_format!r}; known: {FORMATS}")
    mode = "append" if append and file_format != "json" else "overwrite"
    writer = drop_internal(df).write.mode(mode)
    if file_format == "csv":
        writer = writer.option("header", True).option("encoding", encoding).option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif file_format == "parquet":
        writer.parquet(path)
    else:
        writer.option("encoding", encoding).option("ignoreNullFields", False).json(path, compression=compression)


def write_partitioned(df: DataFrame, path: str, partition_columns: Sequence[str], file_format: str = "json") -> None:
    """Append below ``column=value`` folders.

    Rows are first brought together by folder, so that the number of files does not grow with tasks
    times folders. It is done with a rebalance, which splits a folder that holds a large share of the
    rows between several tasks and merges small ones.
    """
    if file_format not in FORMATS:
        raise ValueError(f"unsupported format {file_format!r}; known: {FORMATS}")
    spread = drop_internal(df).hint("rebalance", *[F.col(c) for c in partition_columns])
    spread.write.mode("append").partitionBy(*partition_columns).format("json" if file_format == "jsonl" else file_format).save(path)


def write_domain(tables: Mapping[str, DataFrame], base_path: str) -> None:
    """Every table of a domain as JSON, the raw layer, compressed file by file; a reader knows it by the files' names."""
    for name, df in tables.items():
        write_files(df, f"{base_path.rstrip('/')}/{name}.json", "json", compression="gzip")
