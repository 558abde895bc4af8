"""Streams of messages: key, value struct, timestamp, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_files(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of the files at a path; a bound on files per batch is the batch size of the consumer.

    The last part of the path is given to Spark as a pattern, because a plain path has to be a folder
    while a pattern may also match a single file.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.load(path if any(c in name for c in "*?[{") else f"{folder}/{{{name}}}")


def kafka_options(servers: str, topic: str, group: str = "strata", batch_size: int | None = None, start: str = "earliest") -> dict[str, str]:
    """Reader options of the Kafka connector (its jar is not part of Spark)."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "groupIdPrefix": group, "startingOffsets": start}
    if batch_size:
        options["maxOffsetsPerTrigger"] = str(batch_size)
    return options


def from_kafka(spark: SparkSession, value_schema: T.StructType | str, **kwargs: object) -> DataFrame:
    raw = spark.readStream.format("kafka").options(**kafka_options(**kwargs)).option("includeHeaders", True).load()
    return raw.select(
        F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), value_schema).alias("value"),
        "timestamp", "headers", "partition", "offset", "topic",
    )


def messages(rows: DataFrame, topic: str, key: str, timestamp: str) -> DataFrame:
    """Give plain rows the shape of topic messages."""
    return rows.select(
        F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.struct("*").alias("value"),
        F.col(timestamp).cast("timestamp").alias("timestamp"), F.create_map().cast("map<string,string>").alias("headers"),
    )
