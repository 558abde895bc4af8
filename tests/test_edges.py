"""Cases at the edges: types that do not fit, white space and letters of all alphabets, null keys, split groups."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import predicates
from strata.operators import dedup, transforms, windows
from strata.quality import monitor, profile, rules
from strata.streaming import runner, sources
from strata.streaming import windows as stream_windows
from strata.warehouse import scd, star
from tests.conftest import one, rows


def test_rows_a_microsecond_apart_differ(spark):
    at = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, at), (1, at + dt.timedelta(microseconds=1)), (1, at)], "a int, `t.s` timestamp")
    assert one(dedup.duplicate_summary(df)) == (3, 2, 1)
    assert one(dedup.duplicate_summary(df.select(F.col("`t.s`").cast("timestamp_ntz").alias("t")))) == (3, 2, 1)


@pytest.mark.parametrize("kind", ["double", "decimal(18,2)", "int"])
def test_running_metrics_do_not_depend_on_the_split(spark, kind):
    rng = random.Random(1)
    df = spark.createDataFrame([(i % 3, rng.randrange(50), i, None if i % 7 == 0 else rng.uniform(-1e3, 1e3)) for i in range(400)], "g int, o int, id int, v double").withColumn("v", F.col("v").cast(kind))
    metrics = {"s": {"function": "running_sum", "column": "v"}, "a": {"function": "running_avg", "column": "v"}, "n": {"function": "row_number"}}
    whole, split = (rows(windows.window(df, ["g"], "o", metrics, ["id"], hot_rows=h)) for h in (10_000, 20))
    assert whole == split


def test_order_leaves_out_what_has_no_order(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2})], "k int, m map<string,int>").withColumn("s", F.struct("m")).withColumn("l", F.array("m"))
    assert windows.tie_columns(df, ["k"]) == [] and dedup.deduplicate(df, ["k"]).count() == 1


def test_text_against_a_number_is_no_match(spark):
    df = spark.createDataFrame([("5", 5), ("x", 6), (None, None)], "s string, n int")
    kept = lambda filters: df.where(predicates.filter_condition(filters, df.schema)).count()
    assert kept({"s": 5}) == kept({"s": [5, 6]}) == kept({"n": "five"}) == 0
    assert kept({"s": [5, None]}) == 1 and kept({"s": "5"}) == kept({"n": 5}) == kept({"n": ["x", 6]}) == 1
    assert [r[0] for r in df.select(predicates.threshold("s", "gte", 5)).collect()] == [True, False, False]
    assert [r.record_id for r in rules.failures(df.where("s IS NOT NULL"), [rules.enum_check("s", [5, "x"])], "n").collect()] == ["5"]
    errors = [r[0] for r in transforms.validate(df, {"s": {"min": 6, "enum": [5]}}).select(F.size("_validation_errors")).collect()]
    assert errors == [2, 2, 0]


def test_patterns_know_all_letters(spark):
    df = spark.createDataFrame([(1, "josé@x.com"), (2, "jose@x"), (3, "　 ")], "id int, email string")
    bad = rules.failures(df, [r for r in rules.HEALTH_RULES if r.name == "email"] + [rules.required("email")], "id")
    assert sorted({(r.record_id, r.rule_name) for r in bad.collect()}) == [("2", "pattern"), ("3", "pattern"), ("3", "required")]


def test_profile_of_odd_names(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (3, None, 4.0)], ["it's", "a.b", "c`d"])
    got = {r.column_name: (r.total_count, r.null_count, r.unique_count) for r in profile.profile_columns(df).collect()}
    assert got == {"it's": (2, 0, 2), "a.b": (2, 1, 1), "c`d": (2, 0, 2)}
    assert profile.profile_dataset(df, "x").first().overall_completeness == pytest.approx(5 / 6, abs=1e-4)


def test_upsert_keeps_rows_without_a_key(spark):
    target = spark.createDataFrame([(1, "a", 10), (None, "t", 11), (None, "u", 12)], "k int, v string, sk bigint")
    source = spark.createDataFrame([(1, "A"), (2, "b"), (None, "s")], "k int, v string")
    got = rows(scd.upsert(target, source, ["k"]).select("v", "_action"))
    assert got == [("A", "updated"), ("b", "inserted"), ("s", "inserted"), ("t", "kept"), ("u", "kept")]
    keyed = rows(scd.scd1(target, source, ["k"], "sk").select("v", "sk"))
    assert [k for k in keyed if k[0] in "Atu"] == [("A", 10), ("t", 11), ("u", 12)] and sorted(s for v, s in keyed if v in "bs") == [13, 14]
    plan = scd.upsert(target, source, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(k") >= 2


def test_versions_without_a_key_stay_open(spark):
    target = spark.createDataFrame([(None, "t", dt.date(2024, 1, 1), None, True), (1, "a", dt.date(2024, 1, 1), None, True)], "k int, v string, effective_date date, end_date date, is_current boolean")
    source = spark.createDataFrame([(1, "b")], "k int, v string")
    got = rows(scd.scd2(target, source, ["k"], "2024-02-01").select("v", "is_current", "_action"))
    assert got == [("a", False, "expired"), ("b", True, "updated"), ("t", True, "untouched")]


def test_fact_keys_have_all_digits(spark):
    fact = star.TECH.fact
    assert all(len(r[0]) == 32 for r in star.fact_rows(spark.createDataFrame([("m1",)], "metric_id string"), fact, row_id=("metric_id",)).select(fact.primary_key).collect())


def test_trend_gives_as_many_runs_as_asked(spark):
    history = spark.range(1500).select(F.lit("d").alias("dataset"), F.timestamp_seconds("id").alias("run_ts"), F.lit("m").alias("metric"), F.col("id").cast("double").alias("value"))
    assert monitor.trend(history, "d", "m", 1200).count() == 1200


def test_progress_has_every_batch(spark, tmp_path):
    spark.range(12).repartition(6).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        stream = sources.from_files(spark, str(tmp_path / "in"), spark.range(1).schema, files_per_batch=1)
        query = runner.drain(stream, runner.to_folder(str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    done = runner.progress(query)
    assert sum(p["input_rows"] for p in done) == 12 and len({p["batch"] for p in done if p["input_rows"]}) >= 5


def test_late_rows_go_aside(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    write = stream_windows.in_time_and_late("k", "v", "t", str(tmp_path / "out"), str(tmp_path / "late"), 60, 300)
    for batch, seconds in enumerate([[0, 10], [1000], [20, 990], [None]]):
        write(spark.createDataFrame([("a", 1.0, s if s is None else start + dt.timedelta(seconds=s)) for s in seconds], "k string, v double, t timestamp"), batch)
    parts = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(r["count"] for r in stream_windows.merged(parts).collect()) == [2, 2]
    late = spark.read.parquet(str(tmp_path / "late"))
    assert sorted((r.batch, r.t is None) for r in late.collect()) == [(2, False), (3, True)]
