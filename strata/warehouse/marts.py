"""Staging, intermediate and mart models as functions from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.domain import above
from strata.functions.strings import full_name, title_case
from strata.operators.joins import join_aggregated

MONEY = "decimal(18,2)"


def _opt(df: DataFrame, name: str, kind: str = "string", default: object = None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default).cast(kind)


def _stamped(df: DataFrame, run_ts: str | None) -> DataFrame:
    return df if run_ts is None else df.withColumn("loaded_at", F.lit(run_ts).cast("timestamp"))


def stg_patients(patients: DataFrame, run_ts: str | None = None) -> DataFrame:
    return _stamped(patients.select(
        "patient_id",
        title_case("first_name").alias("first_name"), title_case("last_name").alias("last_name"),
        full_name("first_name", "last_name").alias("full_name"),
        *[_opt(patients, c).alias(c) for c in ("date_of_birth", "gender", "blood_type", "city", "state")],
        (~F.coalesce(_opt(patients, "is_deceased", "boolean"), F.lit(False))).alias("is_active"),
    ), run_ts)


def stg_encounters(encounters: DataFrame, run_ts: str | None = None) -> DataFrame:
    return _stamped(encounters.select(
        "encounter_id", "patient_id", _opt(encounters, "provider_id").alias("provider_id"), "encounter_type", "encounter_date",
        F.coalesce(F.col("total_charges").try_cast("double"), F.lit(0.0)).alias("total_charges"),
        F.coalesce(_opt(encounters, "diagnosis_count", "int"), F.lit(0)).alias("diagnosis_count"),
    ), run_ts)


def int_patient_encounters(patients: DataFrame, encounters: DataFrame) -> DataFrame:
    """Patients with the number and charges of their encounters; 0 without any."""
    metrics = {"encounter_count": F.count(F.lit(1)), "total_charges": F.sum(F.col("total_charges").cast(MONEY)).cast("double")}
    return join_aggregated(patients, encounters, "patient_id", "patient_id", metrics, {"encounter_count": 0, "total_charges": 0.0})


def mart_patient_summary(patient_encounters: DataFrame) -> DataFrame:
    visits, charges = F.col("encounter_count"), F.col("total_charges")
    return patient_encounters.select(
        "patient_id", "full_name", "state", "is_active", "encounter_count", "total_charges",
        # Divided as decimals, so that a tie at the third digit is rounded up and not lost in a double.
        F.when(visits > 0, F.round(charges.cast(MONEY) / visits, 2).cast("double")).otherwise(0.0).alias("avg_charge_per_encounter"),
        above(charges, [(10000, "High Value"), (1000, "Medium Value")], "Low Value").alias("patient_segment"),
    )


def stg_accounts(accounts: DataFrame, run_ts: str | None = None) -> DataFrame:
    return _stamped(accounts.select(
        F.col("account_number").alias("account_id"), "customer_id", "account_type",
        F.coalesce(F.col("current_balance").try_cast("double"), F.lit(0.0)).alias("current_balance"),
        _opt(accounts, "status").alias("status"), _opt(accounts, "opened_date", "date").alias("opened_date"),
    ), run_ts)


def stg_transactions(transactions: DataFrame, run_ts: str | None = None) -> DataFrame:
    return _stamped(transactions.select(
        "transaction_id", "account_id", _opt(transactions, "transaction_type").alias("transaction_type"),
        F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)).alias("amount"), "transaction_date",
        _opt(transactions, "merchant_name").alias("merchant"), _opt(transactions, "merchant_category").alias("category"),
        F.coalesce(_opt(transactions, "is_flagged", "boolean"), F.lit(False)).alias("is_flagged"),
        F.coalesce(_opt(transactions, "fraud_score", "bigint"), F.lit(0)).alias("fraud_score"),
    ), run_ts)


def int_account_transactions(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts with count, debit and credit totals and flagged count of their transactions."""
    amount = F.col("amount").cast(MONEY)
    metrics = {
        "transaction_count": F.count(F.lit(1)),
        "total_debit": F.sum(F.when(amount < 0, -amount)).cast("double"),
        "total_credit": F.sum(F.when(amount >= 0, amount)).cast("double"),
        "flagged_transactions": F.count_if(F.col("is_flagged")),
    }
    zeros = {"transaction_count": 0, "total_debit": 0.0, "total_credit": 0.0, "flagged_transactions": 0}
    return join_aggregated(accounts, transactions, "account_id", "account_id", metrics, zeros)


def mart_account_summary(account_transactions: DataFrame) -> DataFrame:
    flagged, n = F.col("flagged_transactions"), F.col("transaction_count")
    return account_transactions.select(
        "account_id", "customer_id", "account_type", "current_balance", "transaction_count",
        F.round(F.col("total_credit") - F.col("total_debit"), 2).alias("net_flow"),
        F.when(n > 0, F.round(flagged / n, 4)).otherwise(0.0).alias("flagged_rate"),
        above(flagged, [(5, "HIGH"), (0, "MEDIUM")], "LOW").alias("risk_level"),
        above("current_balance", [(0, "GOOD"), (-1000, "WARNING")], "CRITICAL").alias("account_health"),
    )
