"""Run streams to the end of the available data and read their results back as tables.

Every micro-batch writes to its own ``batch=<id>`` folder and overwrites it when it is repeated, so a
batch that is retried after a lost executor or driver leaves no second copy of its rows.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strata.operators.dedup import deduplicate
from strata.session import scratch_path
from strata.sources.incremental import exists

Write = Callable[[DataFrame, int], None]


def batch_folder(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/batch={batch}"


def to_folder(path: str) -> Write:
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(path, batch))

    return write


def drain(stream: DataFrame, write: Write, checkpoint: str, output_mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Process everything that is there now, then stop. The checkpoint remembers how far it came."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True)
    log = _BatchLog()
    stream.sparkSession.streams.addListener(log)
    try:
        query = (writer.queryName(name) if name else writer).start()
        query.awaitTermination()
        BATCHES[str(query.runId)] = log.complete(str(query.runId))
    finally:
        stream.sparkSession.streams.removeListener(log)
    return query


#: Progress of every batch by run; a query by itself remembers the last hundred only.
BATCHES: dict[str, list[dict]] = {}


class _BatchLog(StreamingQueryListener):
    def __init__(self) -> None:
        self.seen: dict[str, list[dict]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event: object) -> None: ...

    def onQueryIdle(self, event: object) -> None: ...

    def onQueryProgress(self, event: object) -> None:
        p = json.loads(event.progress.json)
        self.seen.setdefault(p["runId"], []).append(p)

    def onQueryTerminated(self, event: object) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def complete(self, run: str) -> list[dict]:
        """All progress of an ended run; events arrive in order, the end last."""
        self.ended.setdefault(run, threading.Event()).wait(30)
        return self.seen.get(run, [])


def run_to_table(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Results of a stream as a table with a ``batch`` column."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    drain(stream, to_folder(f"{base}/out"), f"{base}/checkpoint", output_mode)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    if not exists(spark, f"{base}/out"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/out")


def latest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final state of an ``update`` stream: the row of the last batch per key."""
    return deduplicate(table, list(keys), ["batch"], keep="last").drop("batch")


def last_batch(table: DataFrame) -> DataFrame:
    """Final state of a ``complete`` stream: the rows of the last batch."""
    newest = table.agg(F.max("batch").alias("__newest"))
    return table.join(newest, F.col("batch") == F.col("__newest"), "left_semi").drop("batch")


def split_dead_letters(rows: DataFrame, checks: Mapping[str, Column], failed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters): a row failing a check goes to the letters with the first reason."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()])
    marked = rows.withColumn("error", reason)
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull()).withColumn("failed_at", failed_at)


def with_dead_letters(handler: Callable[[DataFrame], DataFrame], checks: Mapping[str, Column], out: str, letters: str, metrics: str | None = None) -> Write:
    """Batch writer that handles good rows, keeps bad ones apart and notes both numbers. The batch is evaluated once."""
    def write(rows: DataFrame, batch: int) -> None:
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = split_dead_letters(kept, checks, F.current_timestamp())
            handler(good).write.mode("overwrite").parquet(batch_folder(out, batch))
            bad.write.mode("overwrite").parquet(batch_folder(letters, batch))
        finally:
            kept.unpersist()
        if metrics:
            spark = rows.sparkSession
            sizes = (
                spark.read.schema(handler(good).schema).parquet(batch_folder(out, batch)).agg(F.count(F.lit(1)).alias("processed"), F.lit(1).alias("one"))
                .join(spark.read.schema(bad.schema).parquet(batch_folder(letters, batch)).agg(F.count(F.lit(1)).alias("failed"), F.lit(1).alias("one")), "one")
            )
            counted = sizes.select((F.col("processed") + F.col("failed")).alias("received"), "processed", "failed")
            counted.write.mode("overwrite").parquet(batch_folder(metrics, batch))

    return write


def by_topic(routes: Mapping[str, Callable[[DataFrame], DataFrame]], out: str) -> Write:
    """Batch writer that sends each topic's messages through its handler into ``out/<topic>``. The batch is evaluated once."""
    def write(rows: DataFrame, batch: int) -> None:
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for topic, handler in routes.items():
                values = kept.where(F.col("topic") == topic).select("value.*")
                handler(values).write.mode("overwrite").parquet(batch_folder(f"{out}/{topic}", batch))
        finally:
            kept.unpersist()

    return write


def progress(query: StreamingQuery) -> list[dict[str, object]]:
    """All batches of a run: input rows, duration, end offset and (where the source knows it) the lag behind the newest message."""
    return [
        {
            "batch": p["batchId"], "input_rows": p["numInputRows"], "duration_ms": p["durationMs"].get("triggerExecution"),
            "end_offset": p["sources"][0]["endOffset"] if p["sources"] else None,
            "lag": (p["sources"][0].get("metrics") or {}).get("maxOffsetsBehindLatest") if p["sources"] else None,
        }
        for p in BATCHES.get(str(query.runId)) or query.recentProgress
    ]
