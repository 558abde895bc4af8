from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.session import scratch_path
from strata.streaming import handlers, runner, sources, windows
from tests.conftest import one, rows


EVENTS = "key string, at string, v double"


def events_stream(spark, batches, files_per_batch=None):
    folder = scratch_path(spark, "in")
    schema = spark.createDataFrame([], EVENTS).schema
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return sources.from_files(spark, f"{folder}/*", schema, files_per_batch=files_per_batch).withColumn("ts", F.col("at").cast("timestamp"))


def test_windows_on_tables(spark):
    data = [("a", "2024-01-01 00:00:30", "5"), ("a", "2024-01-01 00:00:59", "x"), ("a", "2024-01-01 00:01:00", "1"), ("b", "2024-01-01 00:00:10", None)]
    df = spark.createDataFrame(data, "k string, at string, v string").withColumn("ts", F.col("at").cast("timestamp"))
    got = windows.windowed(df, "k", "v", "ts")
    assert [(r["key"], str(r["window_start"])[14:], r["count"], r["sum"], r["avg"]) for r in got.orderBy("key", "window_start").collect()] == [
        ("a", "00:00", 2, 5.0, 2.5), ("a", "01:00", 1, 1.0, 1.0), ("b", "00:00", 1, 0.0, 0.0)]
    assert windows.windowed(df, "k", "v", "ts", 60, 30).count() == 5
    assert one(windows.window_at(got, "a", "2024-01-01 00:00:45").select("count")) == (2,)
    assert windows.window_at(got, "c", "2024-01-01 00:00:45").count() == 0
    assert windows.drop_expired(got, "2024-01-01 00:06:00").count() == 1
    assert windows.window_values(df, "k", "v", "ts").count() == 4


@pytest.mark.parametrize("per_batch", [None, 1])
def test_stream_equals_table(spark, per_batch):
    batches = [[("a", "2024-01-01 00:00:01", 1.0), ("b", "2024-01-01 00:00:02", 2.0)], [("a", "2024-01-01 00:00:03", 3.0)], [("a", "2024-01-01 00:02:03", 4.0)]]
    stream = windows.windowed(events_stream(spark, batches, per_batch), "key", "v", "ts", max_age_seconds=300)
    got = runner.latest(runner.run_to_table(stream, "w", "update"), ["key", "window_start"])
    table = spark.createDataFrame([r for b in batches for r in b], EVENTS).withColumn("ts", F.col("at").cast("timestamp"))
    assert rows(got.select("key", "window_start", "count", "sum", "avg")) == rows(windows.windowed(table, "key", "v", "ts").select("key", "window_start", "count", "sum", "avg"))


def test_late_rows_are_dropped(spark):
    batches = [[("a", "2024-01-01 01:00:00", 1.0)], [("a", "2024-01-01 01:00:10", 1.0)], [("a", "2024-01-01 00:10:00", 9.0), ("a", "2024-01-01 00:59:30", 5.0)]]
    stream = windows.windowed(events_stream(spark, batches, 1), "key", "v", "ts", max_age_seconds=300)
    got = runner.latest(runner.run_to_table(stream, "late", "update"), ["key", "window_start"])
    assert [(str(r["window_start"])[11:16], r["sum"]) for r in got.orderBy("window_start").collect()] == [("00:59", 5.0), ("01:00", 2.0)]


def test_a_second_run_continues(spark):
    base, folder = scratch_path(spark, "again"), scratch_path(spark, "again-in")
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        stream = sources.from_files(spark, f"{folder}/*", schema)
        runner.drain(stream, runner.to_folder(f"{base}/out"), f"{base}/checkpoint")
        return spark.read.schema(schema).parquet(f"{base}/out").count()

    spark.createDataFrame([("a", "x", 1.0)], schema).write.parquet(f"{folder}/1")
    assert run() == 1 and run() == 1
    spark.createDataFrame([("b", "y", 2.0)], schema).write.parquet(f"{folder}/2")
    assert run() == 2


def test_repeated_batch_overwrites(spark):
    path = scratch_path(spark, "batch")
    df = spark.range(3)
    for _ in range(2):
        runner.to_folder(path)(df, 7)
    assert spark.read.parquet(path).count() == 3


def test_dead_letters(spark):
    base = scratch_path(spark, "dlq")
    df = spark.createDataFrame([(1, "a", 5.0, 80), (2, "b", None, 10), (3, "c", 1.0, None)], "transaction_id int, account_id string, amount double, fraud_score int")
    checks = {"no amount": F.col("amount").isNotNull(), "no score": F.col("fraud_score") >= 0}
    write = runner.with_dead_letters(handlers.transactions, checks, f"{base}/good", f"{base}/bad", f"{base}/metrics")
    for _ in range(2):
        write(df, 0)
    assert rows(spark.read.parquet(f"{base}/good").select("transaction_id", "risk_level")) == [(1, "HIGH")]
    assert rows(spark.read.parquet(f"{base}/bad").where("failed_at IS NOT NULL").select("transaction_id", "error")) == [(2, "no amount"), (3, "no score")]
    assert rows(spark.read.parquet(f"{base}/metrics").select("received", "processed", "failed")) == [(3, 1, 2)]


def test_handlers(spark):
    vitals = "struct<heart_rate:int,blood_pressure_systolic:int,temperature:double>"
    df = spark.createDataFrame([("p", (151, 181, 103.1)), ("q", (150, 180, 103.0)), ("r", (None, 200, None)), ("s", None)], f"patient_id string, vitals {vitals}")
    assert [r["alerts"] for r in handlers.encounters(df).orderBy("patient_id").collect()] == [["Tachycardia detected", "Hypertensive crisis", "High fever"], [], ["Hypertensive crisis"], []]
    df = spark.createDataFrame([(1, 91.0, 80.1), (2, 90.0, 80.0), (3, None, 95.0)], "server_id int, cpu_usage_pct double, memory_used_pct double")
    assert [r["alerts"] for r in handlers.metrics(df).orderBy("server_id").collect()] == [["Critical CPU usage", "High memory usage"], ["High CPU usage"], ["Critical memory usage"]]
    df = spark.createDataFrame([(1, 71, 1.0), (2, 70, 3001.0), (3, None, -3000.5), (4, 91, 0.0)], "transaction_id int, fraud_score int, amount double").withColumn("account_id", F.lit("a"))
    assert [r["risk_level"] for r in handlers.transactions(df).orderBy("transaction_id").collect()] == ["HIGH", "MEDIUM", "LOW", "HIGH"]
    alerts = handlers.fraud_alerts(handlers.raise_fraud_alerts(df))
    assert rows(alerts.select("transaction_id", "action")) == [(2, "REVIEW"), (3, "REVIEW"), (4, "BLOCK")]
    df = spark.createDataFrame([(1, "SEV2"), (2, "SEV3"), (3, None)], "incident_id int, severity string").withColumn("server_id", F.lit(1))
    assert [r["auto_page"] for r in handlers.incidents(df).orderBy("incident_id").collect()] == [True, False, False]
    df = spark.createDataFrame([(3.0, 4), (2.0, None)], "grade_points double, credits int")
    assert one(handlers.grade_stats(df)) == (2, 2.57)
    assert one(handlers.lab_stats(spark.createDataFrame([(True, False), (False, None)], "abnormal_flag boolean, critical_flag boolean"))) == (2, 1, 0, 0.5)
    assert set(handlers.HANDLERS) == {f"{d}.{t}" for d, ts in {"health": ["encounters", "lab_results"], "finance": ["transactions", "fraud_alerts"], "tech": ["metrics", "incidents"], "university": ["enrollments", "grades"]}.items() for t in ts}


def test_complete_mode_counts_every_batch(spark):
    batches = [[("a", "x", 1.0)], [("b", "y", 2.0), ("c", "z", 3.0)]]
    stream = events_stream(spark, batches, 1).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert rows(runner.last_batch(runner.run_to_table(stream, "complete", "complete"))) == [(3, 6.0)]


def test_progress(spark):
    base = scratch_path(spark, "progress")
    query = runner.drain(events_stream(spark, [[("a", "2024-01-01", 1.0)], [("b", "2024-01-02", 1.0)]], 1), runner.to_folder(f"{base}/out"), f"{base}/checkpoint")
    seen = runner.progress(query)
    assert sum(p["input_rows"] for p in seen) == 2 and [p["batch"] for p in seen][:2] == [0, 1]


def test_kafka_options():
    options = sources.kafka_options("h:9092", "tech.metrics", batch_size=100)
    assert options["subscribe"] == "tech.metrics" and options["maxOffsetsPerTrigger"] == "100"
