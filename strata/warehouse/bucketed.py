"""Tables in hash buckets of their key: a merge reads, joins and writes only the buckets that its batch touches.

A table is a folder with the rows of bucket b, as version v wrote them, in ``data/version=v/bucket=b``, and a small
manifest for each version that names the version of every bucket. A merge writes the touched buckets under a
new version and its manifest last: readers see the old table or the new one, a repeated or lost merge leaves
nothing half done, and the other buckets' files stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions._cols import named
from strata.warehouse.scd import ACTION, upsert

BUCKETS = 256
MANIFEST = "bucket int, written long, buckets int, keys array<string>"
#: Takes the old rows and the batch, both of the touched buckets only, and gives the new rows.
Change = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a key: the first 32 bits of the SHA-256 of its parts in text form; a null part is a text of its own."""
    text = F.concat_ws("|", *[F.coalesce(named(k).cast("string"), F.lit("\x00")) for k in keys])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """One version of a table: where each bucket that has rows was written last."""

    path: str
    version: int
    buckets: int
    keys: tuple[str, ...]
    written: dict[int, int]

    def rows(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame:
        """The rows of all buckets or of some, without the bucket's number."""
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(self.written.items()) if only is None or b in only]
        schema = spark.read.parquet(f"{self.path}/empty").schema
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int, version: int, kept: dict[int, int]) -> None:
    spark, folder = df.sparkSession, f"{path}/data/version={version}"
    rows = df.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", F.col("bucket"))  # splits a large bucket
    rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    here = {r[0] for r in spark.read.schema(f"{_fields(df)}, bucket int").parquet(folder).select("bucket").distinct().collect()}
    manifest = [(b, v, buckets, list(keys)) for b, v in {**kept, **dict.fromkeys(here, version)}.items()]
    manifest = manifest or [(None, None, buckets, list(keys))]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a table as version 0. It may not have a column ``bucket``, which names the folders."""
    if "bucket" in (c.lower() for c in df.columns):
        raise ValueError("a column named 'bucket' cannot be kept beside the folders of that name")
    path = path.rstrip("/")
    df.where("1 = 0").coalesce(1).write.mode("overwrite").parquet(f"{path}/empty")
    _write(df, path, keys, buckets, 0, {})


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version of a table, or an earlier one. A manifest has one row for each bucket."""
    path = path.rstrip("/")
    listed = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{path}/manifest")
    listed = listed.where(F.col("version") == (F.lit(version) if version is not None else listed.agg(F.max("version")).first()[0]))
    rows = listed.select("bucket", "written", "version", "buckets", "keys").collect()
    if not rows:
        raise ValueError(f"{path} has no such version")
    return Snapshot(path, rows[0].version, rows[0].buckets, tuple(rows[0]["keys"]), {r.bucket: r.written for r in rows if r.bucket is not None})


def merge(spark: SparkSession, path: str, source: DataFrame, *, order_by: Sequence[str] = (), update_columns: Sequence[str] | None = None, change: Change | None = None) -> Snapshot:
    """Bring a batch into the table and return the new version.

    By default :func:`scd.upsert` by the table's key; ``change`` may do anything else that needs only rows of the same
    key, such as :func:`scd.scd2` without a surrogate. Every evaluation of the batch has to give the same rows. An
    empty batch touches nothing and still makes a version.
    """
    now = snapshot(spark, path)
    touched = {r[0] for r in source.select(bucket_of(now.keys, now.buckets)).distinct().collect()}  # as many as buckets at most
    old = now.rows(spark, touched)
    new = change(old, source) if change else upsert(old, source, list(now.keys), update_columns, order_by)
    new = new.drop(ACTION).select(*[named(c) for c in old.columns])
    _write(new, now.path, now.keys, now.buckets, now.version + 1, {b: v for b, v in now.written.items() if b not in touched})
    return snapshot(spark, path)


def files_left(spark: SparkSession, before: Snapshot, after: Snapshot) -> DataFrame:
    """One row: the buckets that a merge wrote and those that it left as they were."""
    kept = sum(after.written.get(b) == v for b, v in before.written.items())
    return spark.range(1).select(F.lit(len(after.written) - kept).cast("long").alias("buckets_written"), F.lit(kept).cast("long").alias("buckets_kept"))
