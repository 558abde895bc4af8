"""Event handlers: functions from event rows to result rows, the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.domain import above
from strata.functions.strings import present_items
from strata.operators.aggregate import weighted_mean


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _stamp(df: DataFrame) -> DataFrame:
    """Streams get the time of their micro-batch."""
    return df.withColumn("processed_at", F.current_timestamp()) if df.isStreaming else df


# Alert texts and limits.
def encounter_alerts(heart_rate: Column, systolic: Column, temperature: Column) -> Column:
    def over(value: Column, limit: float, text: str) -> Column:
        return F.when(F.coalesce(value, F.lit(0)) > limit, F.lit(text))

    return present_items(
        over(heart_rate, 150, "Tachycardia detected"),
        over(systolic, 180, "Hypertensive crisis"),
        over(temperature, 103, "High fever"),
    )


def level_alert(value: Column, what: str) -> Column:
    return F.when(value > 90, F.lit(f"Critical {what} usage")).when(value > 80, F.lit(f"High {what} usage"))


def encounters(df: DataFrame) -> DataFrame:
    v = "vitals"
    alerts = encounter_alerts(F.col(f"{v}.heart_rate"), F.col(f"{v}.blood_pressure_systolic"), F.col(f"{v}.temperature"))
    return _stamp(df.select(_opt(df, "encounter_id").alias("encounter_id"), "patient_id", alerts.alias("alerts")))


def lab_results(df: DataFrame) -> DataFrame:
    return _stamp(df.select("patient_id", "test_code", "value", F.col("abnormal_flag").alias("is_abnormal"), F.col("critical_flag").alias("is_critical")))


def transactions(df: DataFrame) -> DataFrame:
    risk = above(_or_zero(df, "fraud_score"), [(70, "HIGH"), (40, "MEDIUM")], "LOW")
    return _stamp(df.select("transaction_id", "account_id", "amount", risk.alias("risk_level")))


def raise_fraud_alerts(df: DataFrame) -> DataFrame:
    """Transactions that call for an alert, as events of their own."""
    score, size = F.col("fraud_score"), F.abs(F.col("amount"))
    risky = df.where((score > 80) | (size > 3000))
    return risky.select(
        "transaction_id", "account_id", "amount", "fraud_score",
        F.when(score > 90, "HIGH").otherwise("MEDIUM").alias("severity"),
    )


def fraud_alerts(df: DataFrame) -> DataFrame:
    action = F.when(F.col("severity") == "HIGH", "BLOCK").otherwise("REVIEW")
    return _stamp(df.select(_opt(df, "alert_id").alias("alert_id"), "transaction_id", "severity", action.alias("action")))


def metrics(df: DataFrame) -> DataFrame:
    cpu, memory = _or_zero(df, "cpu_usage_pct"), _or_zero(df, "memory_used_pct")
    alerts = present_items(level_alert(cpu, "CPU"), level_alert(memory, "memory"))
    return _stamp(df.select("server_id", cpu.alias("cpu_usage"), memory.alias("memory_usage"), alerts.alias("alerts")))


def incidents(df: DataFrame) -> DataFrame:
    page = F.coalesce(F.col("severity").isin("SEV1", "SEV2"), F.lit(False))
    return _stamp(df.select("incident_id", "server_id", "severity", page.alias("auto_page")))


def enrollments(df: DataFrame) -> DataFrame:
    return _stamp(df.select("enrollment_id", "student_id", "course_code", F.lit("CONFIRMED").alias("status")))


def grades(df: DataFrame) -> DataFrame:
    return _stamp(df.select("enrollment_id", "student_id", "grade"))


HANDLERS = {
    "health.encounters": encounters,
    "health.lab_results": lab_results,
    "finance.transactions": transactions,
    "finance.fraud_alerts": fraud_alerts,
    "tech.metrics": metrics,
    "tech.incidents": incidents,
    "university.enrollments": enrollments,
    "university.grades": grades,
}


# Counters over a whole stream: run them with the ``complete`` output mode.
def lab_stats(df: DataFrame) -> DataFrame:
    labs, abnormal = F.count(F.lit(1)), F.count_if(F.col("abnormal_flag"))
    return df.agg(
        labs.alias("lab_count"), abnormal.alias("abnormal_labs"), F.count_if(F.col("critical_flag")).alias("critical_labs"),
        (abnormal / F.greatest(labs, F.lit(1))).alias("abnormal_rate"),
    )


def transaction_stats(df: DataFrame) -> DataFrame:
    volume = F.coalesce(F.sum(F.abs(F.col("amount").cast("decimal(18,2)"))), F.lit(0)).cast("double")
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("transaction_count"), F.round(volume, 2).alias("total_volume"), F.round(volume / F.greatest(n, F.lit(1)), 2).alias("avg_transaction"),
        F.count_if((F.col("fraud_score") > 80) | (F.abs(F.col("amount")) > 3000)).alias("fraud_alerts"),
    )


def metric_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("metric_count"), F.count_if(_or_zero(df, "cpu_usage_pct") > 90).alias("high_cpu_alerts"))


def grade_stats(df: DataFrame) -> DataFrame:
    gpa = weighted_mean(F.col("grade_points"), F.col("credits"))
    return df.agg(F.count(F.lit(1)).alias("grade_count"), F.round(gpa, 2).alias("average_gpa"))
