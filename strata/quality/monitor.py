"""Monitoring rules over profile metrics: alerts, routing, history and trend."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.dates import hours_between
from strata.functions.predicates import COMPARE
from strata.operators.transforms import project_to
from strata.quality.rules import THRESHOLDS

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
GATE_SCORE = 80


@dataclass(frozen=True)
class MonitorRule:
    name: str
    metric: str
    operator: str
    threshold: float
    severity: str = "MEDIUM"
    description: str = ""
    enabled: bool = True


def completeness_rule(column: str, minimum: float = 0.95, severity: str = "HIGH") -> MonitorRule:
    return MonitorRule(f"completeness_{column}", f"columns.{column}.completeness", "lt", minimum, severity, f"Column {column} completeness below {minimum:.0%}")


def uniqueness_rule(column: str, minimum: float = 1.0, severity: str = "HIGH") -> MonitorRule:
    return MonitorRule(f"uniqueness_{column}", f"columns.{column}.uniqueness_rate", "lt", minimum, severity, f"Column {column} uniqueness below {minimum:.0%}")


def row_count_rules(minimum: int = 0, maximum: int | None = None, severity: str = "MEDIUM") -> list[MonitorRule]:
    rules = []
    if minimum > 0:
        rules.append(MonitorRule("min_row_count", "row_count", "lt", minimum, severity, f"Row count below minimum {minimum}"))
    if maximum:
        rules.append(MonitorRule("max_row_count", "row_count", "gt", maximum, severity, f"Row count exceeds maximum {maximum}"))
    return rules


def freshness_rule(max_age_hours: float = 24, severity: str = "HIGH") -> MonitorRule:
    return MonitorRule("data_freshness", "age_hours", "gt", max_age_hours, severity, f"Data older than {max_age_hours} hours")


def threshold_rules(dataset: str) -> list[MonitorRule]:
    """Rules for a dataset's score parts (as shares) and its age, from the fixed thresholds."""
    parts = [name for name in THRESHOLDS if name.endswith("_threshold")]
    rules = [MonitorRule(f"{dataset}_{p}", f"{dataset}.{p.removesuffix('_threshold')}", "lt", THRESHOLDS[p], "HIGH") for p in parts]
    return [*rules, freshness_rule(THRESHOLDS["timeliness_hours"])]


def freshness(df: DataFrame, timestamp_column: str, as_of: str) -> DataFrame:
    """Hours since the newest timestamp; infinite when there is none."""
    newest = F.max(timestamp_column)
    age = hours_between(newest, F.lit(as_of).cast("timestamp"))
    return df.agg(F.coalesce(age, F.lit(float("inf"))).alias("age_hours"))


def metrics_frame(columns: DataFrame, dataset: DataFrame, age: DataFrame | None = None) -> DataFrame:
    """(metric, value) rows that monitoring rules refer to, rounded like the profiles."""
    per_column = ("completeness", "uniqueness_rate", "null_rate", "total_count", "null_count", "unique_count", "min_value", "max_value", "mean_value", "median_value", "std_dev")
    tall = columns.select("column_name", *[F.col(c).cast("double").alias(c) for c in per_column]).unpivot(["column_name"], list(per_column), "part", "value")
    rows = tall.select(F.concat(F.lit("columns."), F.col("column_name"), F.lit("."), F.col("part")).alias("metric"), "value")
    overall = ("row_count", "column_count", "duplicate_row_count", "duplicate_rate", "overall_completeness")
    rows = rows.unionByName(dataset.select(*[F.col(c).cast("double").alias(c) for c in overall]).unpivot([], list(overall), "metric", "value"))
    if age is not None:
        rows = rows.unionByName(age.select(F.lit("age_hours").alias("metric"), F.col("age_hours").cast("double").alias("value")))
    return rows.where(F.col("value").isNotNull())


def rules_frame(spark: SparkSession, rules: Sequence[MonitorRule]) -> DataFrame:
    rows = [(i, r.name, r.metric, r.operator, float(r.threshold), r.severity, r.description or f"{r.metric} {r.operator} {r.threshold}") for i, r in enumerate(rules) if r.enabled]
    return spark.createDataFrame(rows, "rule_no int, title string, metric string, operator string, threshold double, severity string, message string")


def alerts(metrics: DataFrame, rules: Sequence[MonitorRule], run_ts: str, first_number: int = 1) -> DataFrame:
    """One row per violated rule, numbered in rule order. The number of rules bounds the number of rows."""
    listed = rules_frame(metrics.sparkSession, rules)
    violated = F.lit(False)
    for name, compare in COMPARE.items():
        violated = violated | ((F.col("operator") == name) & compare(F.col("value"), F.col("threshold")))
    found = listed.join(metrics, "metric").where(violated)
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("rule_no")) + (first_number - 1)
    stamp = F.lit(run_ts).cast("timestamp")
    return found.select(
        F.concat(F.lit("ALT-"), F.date_format(stamp, "yyyyMMdd"), F.lit("-"), F.lpad(number.cast("string"), 4, "0")).alias("alert_id"),
        "severity", "title", "message", F.col("metric").alias("metric_name"), F.col("value").alias("metric_value"), "threshold",
        stamp.alias("created_at"), F.lit(False).alias("acknowledged"),
        F.lit(None).cast("string").alias("acknowledged_by"), F.lit(None).cast("timestamp").alias("acknowledged_at"),
    )


def active_alerts(alert_rows: DataFrame, severity: str | None = None) -> DataFrame:
    rows = alert_rows.where(~F.col("acknowledged"))
    return rows if severity is None else rows.where(F.col("severity") == severity)


def acknowledge(alert_rows: DataFrame, alert_id: str, user: str, run_ts: str) -> DataFrame:
    hit = F.col("alert_id") == alert_id
    return alert_rows.withColumns({
        "acknowledged": hit | F.col("acknowledged"),
        "acknowledged_by": F.when(hit, F.lit(user)).otherwise(F.col("acknowledged_by")),
        "acknowledged_at": F.when(hit, F.lit(run_ts).cast("timestamp")).otherwise(F.col("acknowledged_at")),
    })


ALERT_FIELDS = ("alert_id", "severity", "title", "message", "metric_name", "metric_value", "threshold", "created_at", "acknowledged")


def append_alerts(alert_rows: DataFrame, path: str) -> None:
    """Append alerts as JSON lines."""
    project_to(alert_rows, ALERT_FIELDS).write.mode("append").json(path)


def route(alert_rows: DataFrame, handlers: Mapping[str, Sequence[Callable[[DataFrame], None]]]) -> dict[str, str]:
    """Hand each severity's alerts to its handlers; a handler that fails does not stop the others."""
    problems = {}
    for severity, receivers in handlers.items():
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity {severity!r}")
        for i, receive in enumerate(receivers):
            try:
                receive(alert_rows.where(F.col("severity") == severity))
            except Exception as problem:
                problems[f"{severity}[{i}]"] = str(problem)
    return problems


def append_history(metrics: DataFrame, dataset: str, run_ts: str, path: str) -> None:
    """Append one run's metrics to the history table."""
    metrics.select(F.lit(dataset).alias("dataset"), F.lit(run_ts).cast("timestamp").alias("run_ts"), "metric", "value").write.mode("append").parquet(path)


def trend(history: DataFrame, dataset: str, metric: str, periods: int = 10) -> DataFrame:
    """Values of one metric over the last runs, newest first."""
    rows = history.where((F.col("dataset") == dataset) & (F.col("metric") == metric))
    return rows.select("run_ts", "value").orderBy(F.desc("run_ts")).limit(periods)


def quality_gate(scores: DataFrame, minimum: float = GATE_SCORE) -> DataFrame:
    """Mean of the domain scores (missing and zero scores left out) and the branch to take."""
    mean = F.coalesce(F.avg(F.when(F.col("overall_score") != 0, F.col("overall_score"))), F.lit(0.0))
    return scores.agg(F.round(mean, 4).alias("avg_score"), F.when(mean >= minimum, "transform").otherwise("quality_alert").alias("branch"))
