from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from strata.streaming import runner, state, windows
from tests.conftest import rows
from tests.test_streaming import EVENTS, events_stream


def at(second):
    return f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def test_each_window_comes_once_and_late_rows_stay(spark):
    batches = [
        [("a", at(5), 1.0), ("a", at(59), 2.0), (None, at(10), 4.0), ("b", at(61), None)],
        [("a", at(400), 8.0)],  # the newest event is 340 s after the first window's end
        [("a", at(401), 8.0)],  # the batch that finds it so
        [("a", at(7), 16.0), ("a", at(8), 32.0), ("b", at(62), 64.0), ("c", None, 128.0)],  # the first window is closed, the second is not: 400 - 300 < 120
        [("a", at(420), 1.0)],  # closes the second window, 420 - 300 = 120
    ]
    got = runner.run_to_table(state.window_state(events_stream(spark, batches, 1), "key", "v", "ts"), "window-state")
    found = [(r["key"], r["window_start"] and r["window_start"].strftime("%H:%M"), r["count"], r["sum"], r["late"]) for r in got.collect()]
    assert Counter(found) == Counter([
        ("a", "00:00", 2, 3.0, False), (None, "00:00", 1, 4.0, False), ("a", "00:00", 2, 48.0, True), ("c", None, 1, 128.0, True), ("b", "00:01", 2, 64.0, False)])


def test_closed_windows_and_late_rows_equal_the_table(spark):
    seconds = [(i * 7919) % 5000 for i in range(90)]
    data = [(f"k{s % 3}" if i % 4 else "hot", at(s), float(i)) for i, s in enumerate(seconds)]
    stream = events_stream(spark, [data[i::6] for i in range(6)], 2)
    got = runner.run_to_table(state.window_state(stream, "key", "v", "ts"), "window-state")
    assert got.where("NOT late").groupBy("key", "window_start").count().where("count > 1").count() == 0
    table = spark.createDataFrame(data, EVENTS).withColumn("ts", F.col("at").cast("timestamp"))
    closed = F.unix_seconds("window_end") <= F.unix_seconds(F.lit(at(max(seconds))).cast("timestamp")) - 300
    assert rows(windows.merged(got)) == rows(windows.windowed(table, "key", "v", "ts").where(closed))


def test_empty_stream_has_no_windows(spark):
    assert runner.run_to_table(state.window_state(events_stream(spark, [[]], 1), "key", "v", "ts"), "none").count() == 0


def test_running_totals_touch_only_their_keys(spark):
    batches = [[("a", "x", 1.5), ("b", "x", 2.0), (None, "x", None)], [("a", "x", 3.0), ("a", "x", None)], [("b", "x", -2.0)]]
    sums = {"n": F.lit(1), "big": F.col("v") > 1, "total": F.col("v")}
    out = runner.run_to_table(state.running_totals(events_stream(spark, batches, 1), ["key"], sums), "totals", "update")
    assert out.groupBy("batch").count().agg(F.sum("count")).first()[0] == 5  # 3, 1 and 1 keys
    assert rows(runner.latest(out, ["key"])) == [(None, 1, 0, 0.0), ("a", 3, 2, 4.5), ("b", 2, 1, 0.0)]
