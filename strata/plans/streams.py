"""Streams over the events, transactions and enrollments, drained to a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.aggregate import weighted_mean
from strata.plans.registry import query
from strata.session import scratch_path
from strata.sources import files
from strata.streaming import handlers, runner, sources, state, windows
from strata.tables import VIEWS, load, with_views

NTZ = "timestamp_ntz"


def stream_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A domain table of one given table as a stream of its file."""
    spec = VIEWS[name]
    path = f"{sf.rstrip('/')}/{spec.table}.parquet"
    rows = sources.from_files(spark, path, load(spark, sf, spec.table).schema)
    if spec.where:
        rows = rows.where(spec.where)
    return rows.select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in spec.columns.items()])


def _windows(spark: SparkSession, sf: str, size: int, slide: int | None, label: str) -> DataFrame:
    metrics = stream_view(spark, sf, "metrics").withColumn("cpu", F.col("cpu_usage_pct").cast("decimal(18,2)"))
    stream = windows.windowed(metrics, "server_id", "cpu", "timestamp", size, slide, windows.MAX_AGE_SECONDS)
    table = runner.latest(runner.run_to_table(stream, label, "update"), ["key", "window_start"])
    return table.select(F.col("key").alias("server_id"), *[F.col(c).cast(NTZ).alias(c) for c in ("window_start", "window_end")], "count", "sum", F.round("avg", 6).alias("avg"))


_WINDOW = """CAST(sum(CAST(cpu_usage_pct AS DECIMAL(18,2))) AS DOUBLE) AS sum, round(CAST(sum(CAST(cpu_usage_pct AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg"""


@query("stream_tumbling", with_views("metrics") + f"""
    SELECT server_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end, count(*) AS count, {_WINDOW} FROM metrics GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, 3600, None, "tumbling")


@query("stream_sliding", with_views("metrics") + f"""
    SELECT server_id, start AS window_start, start + INTERVAL 1 HOUR AS window_end, count(*) AS count, {_WINDOW}
    FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, timestamp), time_bucket(INTERVAL 30 MINUTE, timestamp) - INTERVAL 30 MINUTE]) AS start FROM metrics) GROUP BY server_id, start""")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, 3600, 1800, "sliding")


@query("stream_late_rows", with_views("metrics") + f"""
    SELECT server_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, count(*) AS count, round(CAST(sum(CAST(cpu_usage_pct AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum, true AS has_late FROM metrics GROUP BY ALL""")
def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events in several files without any order, a few files a batch: windows and late rows together hold every event."""
    base = scratch_path(spark, "late")
    spec = VIEWS["metrics"].columns
    metrics = load(spark, sf, "events").select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in spec.items()])
    metrics = metrics.select("server_id", "timestamp", F.col("cpu_usage_pct").cast("decimal(18,2)").alias("cpu"))
    metrics.repartition(6).write.parquet(f"{base}/in")
    stream = sources.from_files(spark, f"{base}/in", metrics.schema, files_per_batch=2)
    runner.drain(stream, windows.in_time_and_late("server_id", "cpu", "timestamp", f"{base}/out", f"{base}/late", 3600), f"{base}/checkpoint")
    parts = spark.read.schema("key bigint, window_start timestamp, window_end timestamp, count bigint, sum double").parquet(f"{base}/out").drop("batch")
    late = spark.read.schema(metrics.schema).parquet(f"{base}/late").drop("batch")
    there = late.agg((F.count(F.lit(1)) > 0).alias("has_late"))
    both = windows.merged(parts.unionByName(windows.windowed(late, "server_id", "cpu", "timestamp", 3600).drop("avg")))
    return both.select(F.col("key").alias("server_id"), F.col("window_start").cast(NTZ).alias("window_start"), "count", F.round("sum", 2).alias("sum")).crossJoin(there)


@query("stream_sliding_panes", with_views("metrics") + """
    SELECT server_id, start AS window_start, count(*) AS count, round(CAST(sum(CAST(cpu_usage_pct AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum
    FROM (SELECT *, unnest([time_bucket(INTERVAL 20 MINUTE, timestamp), time_bucket(INTERVAL 20 MINUTE, timestamp) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, timestamp) - INTERVAL 40 MINUTE]) AS start FROM metrics) GROUP BY server_id, start""")
def stream_sliding_panes(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding windows over unordered files: panes of each batch and the late rows' panes are merged into all windows."""
    base, size, slide = scratch_path(spark, "panes"), 3600, 1200
    spec = VIEWS["metrics"].columns
    metrics = load(spark, sf, "events").select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in spec.items()])
    metrics = metrics.select("server_id", "timestamp", F.col("cpu_usage_pct").cast("decimal(18,2)").alias("cpu"))
    metrics.repartition(6).write.parquet(f"{base}/in")
    stream = sources.from_files(spark, f"{base}/in", metrics.schema, files_per_batch=2)
    runner.drain(stream, windows.in_time_and_late("server_id", "cpu", "timestamp", f"{base}/out", f"{base}/late", size, slide_seconds=slide), f"{base}/checkpoint")
    parts = spark.read.schema("key bigint, window_start timestamp, window_end timestamp, count bigint, sum double").parquet(f"{base}/out").drop("batch")
    late = windows.panes(spark.read.schema(metrics.schema).parquet(f"{base}/late").drop("batch"), "server_id", "cpu", "timestamp", size, slide)
    both = windows.merged_panes(parts.unionByName(late), size, slide)
    return both.select(F.col("key").alias("server_id"), F.col("window_start").cast(NTZ).alias("window_start"), "count", F.round("sum", 2).alias("sum"))


@query("stream_window_state", with_views("metrics") + """
    , w AS (SELECT server_id, time_bucket(INTERVAL 1 DAY, timestamp) AS window_start, count(*) AS count, round(CAST(sum(CAST(cpu_usage_pct AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum FROM metrics GROUP BY ALL)
    SELECT *, true AS once FROM w WHERE window_start + INTERVAL 1 DAY + INTERVAL 300 SECONDS <= (SELECT date_trunc('millisecond', max(timestamp)) FROM metrics)""")
def stream_window_state(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a day in keyed state, early events after the later ones in part: those that are closed come once at most, late rows beside them."""
    base = scratch_path(spark, "window-state")
    spec = VIEWS["metrics"].columns
    metrics = load(spark, sf, "events").select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in spec.items()])
    metrics = metrics.select("server_id", F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("cpu_usage_pct").cast("decimal(18,2)").alias("cpu"))
    early = (F.col("timestamp") < "2024-01-16") & (F.crc32(F.col("timestamp").cast("string")) % 50 != 0)
    for part in (early, F.coalesce(~early, F.lit(True))):  # files are read in the order they were written
        metrics.where(part).coalesce(4).write.mode("append").parquet(f"{base}/in")
    stream = sources.from_files(spark, f"{base}/in", metrics.schema, files_per_batch=4)
    found = runner.run_to_table(state.window_state(stream, "server_id", "cpu", "timestamp", 86_400), "window-state")
    whole = found.groupBy("key", "window_start").agg(F.sum("count").alias("count"), F.round(F.sum("sum"), 2).alias("sum"), (F.count_if(~F.col("late")) <= 1).alias("once"))
    return whole.select(F.col("key").alias("server_id"), F.col("window_start").cast(NTZ).alias("window_start"), "count", "sum", "once")


@query("stream_running_totals", with_views("transactions") + """
    SELECT account_id, count(*) AS transaction_count, round(CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_volume,
           count(*) FILTER (WHERE fraud_score > 80 OR abs(amount) > 3000) AS fraud_alerts FROM transactions GROUP BY account_id""")
def stream_running_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Handler counters by account, each batch emitting only the accounts it touches."""
    sums = {
        "transaction_count": F.lit(1), "total_volume": F.abs(F.col("amount").cast("decimal(18,2)")),
        "fraud_alerts": F.coalesce((F.col("fraud_score") > 80) | (F.abs("amount") > 3000), F.lit(False)),
    }
    table = runner.run_to_table(state.running_totals(stream_view(spark, sf, "transactions"), ["account_id"], sums), "running-totals", "update")
    return runner.latest(table, ["account_id"]).withColumn("total_volume", F.round("total_volume", 2))


@query("window_rows", with_views("metrics") + """
    SELECT server_id, time_bucket(INTERVAL 1 MINUTE, timestamp) AS window_start, timestamp, cpu_usage_pct AS value FROM metrics""")
def window_rows(spark: SparkSession, sf: str) -> DataFrame:
    metrics = load(spark, sf, "events").select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in VIEWS["metrics"].columns.items()])
    rows = windows.window_values(metrics, "server_id", "cpu_usage_pct", "timestamp")
    return rows.select(F.col("key").alias("server_id"), F.col("window_start").cast(NTZ).alias("window_start"), "timestamp", "value")


@query("window_point", """
    SELECT event_type, count(*) AS count, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS sum FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-15 13:00:00' AND event_type = 'click' GROUP BY event_type""")
def window_point(spark: SparkSession, sf: str) -> DataFrame:
    """The window of one key that contains a moment."""
    table = windows.windowed(load(spark, sf, "events").withColumn("v", F.col("value").cast("decimal(18,2)")), "event_type", "v", "ts", 3600)
    return windows.window_at(table, "click", "2024-01-15 12:30:00").select(F.col("key").alias("event_type"), "count", F.round("sum", 2).alias("sum"))


@query("window_expiry", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, event_type, count(*) AS count FROM events WHERE time_bucket(INTERVAL 1 MINUTE, ts) >= TIMESTAMP '2024-01-20' - INTERVAL 300 SECONDS GROUP BY ALL")
def window_expiry(spark: SparkSession, sf: str) -> DataFrame:
    table = windows.windowed(load(spark, sf, "events"), "event_type", "value", "ts")
    return windows.drop_expired(table, "2024-01-20 00:00:00").select(F.col("window_start").cast(NTZ).alias("window_start"), F.col("key").alias("event_type"), "count")


def _handled(spark: SparkSession, sf: str, name: str, handler, label: str) -> DataFrame:
    return runner.run_to_table(handler(stream_view(spark, sf, name)), label).drop("batch", "processed_at")


_LEVEL = "CASE WHEN {0} > 90 THEN 'Critical {1} usage' WHEN {0} > 80 THEN 'High {1} usage' END"


@query("stream_metric_alerts", with_views("metrics") + f"""
    SELECT server_id, cpu_usage_pct AS cpu_usage, memory_used_pct AS memory_usage, concat_ws('; ', {_LEVEL.format('cpu_usage_pct', 'CPU')}, {_LEVEL.format('memory_used_pct', 'memory')}) AS alerts FROM metrics""")
def stream_metric_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _handled(spark, sf, "metrics", handlers.metrics, "metric-alerts").withColumn("alerts", F.array_join("alerts", "; "))


@query("stream_risk", with_views("transactions") + """
    SELECT transaction_id, account_id, amount, CASE WHEN fraud_score > 70 THEN 'HIGH' WHEN fraud_score > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM transactions""")
def stream_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _handled(spark, sf, "transactions", handlers.transactions, "risk")


@query("stream_fraud", with_views("transactions") + """
    SELECT transaction_id, CASE WHEN fraud_score > 90 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN fraud_score > 90 THEN 'BLOCK' ELSE 'REVIEW' END AS action
    FROM transactions WHERE fraud_score > 80 OR abs(amount) > 3000""")
def stream_fraud(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions raise alerts, alerts get an action."""
    return _handled(spark, sf, "transactions", lambda t: handlers.fraud_alerts(handlers.raise_fraud_alerts(t)), "fraud").drop("alert_id")


@query("stream_incidents", with_views("incidents") + " SELECT incident_id, server_id, severity, severity IN ('SEV1', 'SEV2') AS auto_page FROM incidents")
def stream_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return _handled(spark, sf, "incidents", handlers.incidents, "incidents")


@query("stream_labs", with_views("lab_results") + " SELECT patient_id, test_code, value, abnormal_flag AS is_abnormal, critical_flag AS is_critical FROM lab_results")
def stream_labs(spark: SparkSession, sf: str) -> DataFrame:
    return _handled(spark, sf, "lab_results", handlers.lab_results, "labs")


def _vitals(rows: DataFrame) -> DataFrame:
    vitals = F.struct(
        F.col("value").cast("int").alias("heart_rate"), F.get_json_object("props", "$.k").cast("int").alias("blood_pressure_systolic"), (F.col("value") / 2 + 80).alias("temperature"))
    return rows.select(F.col("event_id").alias("encounter_id"), F.col("user_id").alias("patient_id"), F.when(F.col("event_type") != "view", vitals).alias("vitals"))


@query("stream_encounters", """
    SELECT event_id AS encounter_id, user_id AS patient_id, CASE WHEN event_type = 'view' THEN '' ELSE concat_ws('; ', CASE WHEN trunc(value) > 150 THEN 'Tachycardia detected' END,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 180 THEN 'Hypertensive crisis' END, CASE WHEN value / 2 + 80 > 103 THEN 'High fever' END) END AS alerts
    FROM events""")
def stream_encounters(spark: SparkSession, sf: str) -> DataFrame:
    """Vitals taken from the events; a message without vitals raises nothing."""
    stream = sources.from_files(spark, f"{sf.rstrip('/')}/events.parquet", load(spark, sf, "events").schema)
    table = runner.run_to_table(handlers.encounters(_vitals(stream)), "encounters").drop("batch", "processed_at")
    return table.withColumn("alerts", F.array_join("alerts", "; "))


@query("stream_enrollments", with_views("enrollments") + " SELECT enrollment_id, student_id, 'C' || course_id AS course_code, 'CONFIRMED' AS status FROM enrollments")
def stream_enrollments(spark: SparkSession, sf: str) -> DataFrame:
    def handle(rows: DataFrame) -> DataFrame:
        return handlers.enrollments(rows.withColumn("course_code", F.concat(F.lit("C"), F.col("course_id").cast("string"))))

    return _handled(spark, sf, "enrollments", handle, "enrollments")


@query("stream_grades", with_views("enrollments") + " SELECT enrollment_id, student_id, grade FROM enrollments WHERE grade IS NOT NULL")
def stream_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _handled(spark, sf, "enrollments", lambda rows: handlers.grades(rows.where(F.col("grade").isNotNull())), "grades")


@query("stream_gpa", with_views("enrollments") + " SELECT count(*) AS grade_count, round(sum(grade_points * credits) / greatest(1, sum(credits)), 2) AS average_gpa FROM enrollments")
def stream_gpa(spark: SparkSession, sf: str) -> DataFrame:
    stream = handlers.grade_stats(stream_view(spark, sf, "enrollments"))
    return runner.last_batch(runner.run_to_table(stream, "gpa", "complete"))


@query("stream_student_gpa", with_views("enrollments") + " SELECT student_id, round(sum(grade_points * credits) / greatest(1, sum(credits)), 6) AS gpa FROM enrollments GROUP BY student_id")
def stream_student_gpa(spark: SparkSession, sf: str) -> DataFrame:
    rows = stream_view(spark, sf, "enrollments")
    stream = rows.groupBy("student_id").agg(F.round(weighted_mean(F.col("grade_points"), F.col("credits")), 6).alias("gpa"))
    return runner.latest(runner.run_to_table(stream, "student-gpa", "update"), ["student_id"])


@query("stream_totals", with_views("transactions") + """
    SELECT count(*) AS transaction_count, CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) AS total_volume, round(CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_transaction,
           count(CASE WHEN fraud_score > 80 OR abs(amount) > 3000 THEN 1 END) AS fraud_alerts FROM transactions""")
def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    stream = handlers.transaction_stats(stream_view(spark, sf, "transactions"))
    return runner.last_batch(runner.run_to_table(stream, "totals", "complete"))


@query("stream_lab_totals", with_views("lab_results") + """
    SELECT count(*) AS lab_count, count(CASE WHEN abnormal_flag THEN 1 END) AS abnormal_labs, count(CASE WHEN critical_flag THEN 1 END) AS critical_labs,
           round(count(CASE WHEN abnormal_flag THEN 1 END) / count(*), 6) AS abnormal_rate FROM lab_results""")
def stream_lab_totals(spark: SparkSession, sf: str) -> DataFrame:
    stream = handlers.lab_stats(stream_view(spark, sf, "lab_results"))
    return runner.last_batch(runner.run_to_table(stream, "lab-totals", "complete")).withColumn("abnormal_rate", F.round("abnormal_rate", 6))


@query("stream_metric_totals", with_views("metrics") + " SELECT count(*) AS metric_count, count(CASE WHEN cpu_usage_pct > 90 THEN 1 END) AS high_cpu_alerts FROM metrics")
def stream_metric_totals(spark: SparkSession, sf: str) -> DataFrame:
    stream = handlers.metric_stats(stream_view(spark, sf, "metrics"))
    return runner.last_batch(runner.run_to_table(stream, "metric-totals", "complete"))


_CHECKS = {"amount is missing or zero": "amount IS NOT NULL AND amount <> 0", "score above 95": "fraud_score <= 95"}


def _dlq(spark: SparkSession, sf: str) -> str:
    base = scratch_path(spark, "dlq")
    stream = stream_view(spark, sf, "transactions").withColumn("amount", F.when(F.col("transaction_type") == "CREDIT", F.col("amount")).otherwise(F.when(F.col("merchant_category") != "5-LOW", F.col("amount"))))
    checks = {text: F.expr(condition) for text, condition in _CHECKS.items()}
    write = runner.with_dead_letters(handlers.transactions, checks, f"{base}/good", f"{base}/letters", f"{base}/metrics")
    runner.drain(stream, write, f"{base}/checkpoint")
    return base


_DLQ = with_views("transactions") + """, t AS (SELECT * REPLACE (CASE WHEN transaction_type = 'CREDIT' OR merchant_category <> '5-LOW' THEN amount END AS amount) FROM transactions),
    m AS (SELECT *, CASE WHEN amount IS NULL OR amount = 0 THEN 'amount is missing or zero' WHEN fraud_score > 95 THEN 'score above 95' END AS error FROM t)"""


@query("stream_dlq", _DLQ + " SELECT transaction_id, coalesce(error, 'none') AS error, CASE WHEN error IS NULL THEN CASE WHEN fraud_score > 70 THEN 'HIGH' WHEN fraud_score > 40 THEN 'MEDIUM' ELSE 'LOW' END END AS risk_level FROM m")
def stream_dlq(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows are handled, each bad row becomes a dead letter with its reason."""
    base = _dlq(spark, sf)
    good = spark.read.schema("transaction_id bigint, risk_level string").parquet(f"{base}/good").select("transaction_id", F.lit("none").alias("error"), "risk_level")
    letters = spark.read.schema("transaction_id bigint, error string").parquet(f"{base}/letters").select("transaction_id", "error")
    return good.unionByName(letters.withColumn("risk_level", F.lit(None).cast("string")))


@query("stream_run_metrics", _DLQ + " SELECT count(*) AS received, count(CASE WHEN error IS NULL THEN 1 END) AS processed, count(error) AS failed FROM m")
def stream_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    batches = spark.read.schema("received bigint, processed bigint, failed bigint").parquet(f"{_dlq(spark, sf)}/metrics")
    return batches.agg(*[F.sum(c).alias(c) for c in ("received", "processed", "failed")])


_ROUTED = {
    "health.encounters": "patient_id", "health.lab_results": "patient_id", "finance.transactions": "account_id", "finance.fraud_alerts": "alert_id",
    "tech.metrics": "server_id", "tech.incidents": "server_id", "university.enrollments": "student_id", "university.grades": "student_id",
}


@query("stream_routes", f"""
    SELECT [{', '.join(f"'{t}'" for t in _ROUTED)}][event_id % 8 + 1] AS topic, count(*) AS results, count(DISTINCT user_id) AS keys FROM events GROUP BY topic""")
def stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    """One stream of eight topics; each topic goes to its own handler and folder."""
    base = scratch_path(spark, "routes")
    events = sources.from_files(spark, f"{sf.rstrip('/')}/events.parquet", load(spark, sf, "events").schema)
    ids = [F.col("user_id").alias(n) for n in ("patient_id", "account_id", "server_id", "student_id")] + [F.col("event_id").alias(n) for n in ("encounter_id", "transaction_id", "incident_id", "enrollment_id")]
    shaped = events.select(
        F.element_at(F.array(*[F.lit(t) for t in _ROUTED]), (F.col("event_id") % 8 + 1).cast("int")).alias("kind"), "ts", *ids, F.col("user_id").cast("string").alias("alert_id"),
        F.concat(F.lit("SEV"), (F.col("event_id") % 4 + 1).cast("string")).alias("severity"), F.least("value", F.lit(100.0)).alias("cpu_usage_pct"),
        F.struct(F.col("value").alias("heart_rate"), F.col("value").alias("blood_pressure_systolic"), F.col("value").alias("temperature")).alias("vitals"),
        F.col("event_type").alias("test_code"), "value", F.col("value").alias("amount"), (F.col("value") > 50).alias("abnormal_flag"), (F.col("value") > 90).alias("critical_flag"),
        F.col("event_type").alias("course_code"), F.lit("A").alias("grade"))
    topics = sources.messages(shaped, "mixed", "server_id", "ts").withColumn("topic", F.col("value.kind"))
    runner.drain(topics, runner.by_topic({t: handlers.HANDLERS[t] for t in _ROUTED}, base), f"{base}-checkpoint")
    counts = [spark.read.parquet(f"{base}/{t}").agg(F.lit(t).alias("topic"), F.count(F.lit(1)).alias("results"), F.count_distinct(key).alias("keys")) for t, key in _ROUTED.items()]
    return reduce(DataFrame.unionByName, counts)


@query("stream_batches", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files read as a stream of bounded batches; together they are the whole table."""
    folder = scratch_path(spark, "batches")
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderpriority")
    files.write_files(rows.repartition(12), folder, "csv")
    stream = files.read_batches(spark, folder, rows.schema, files_per_batch=4)
    return runner.run_to_table(stream, "csv-batches").drop("batch")
