"""Validation rules on columns and rows.

A rule set compiles to one array of failures per row, computed in one projection; the array is
exploded for the list of failures and summed for the report. Only uniqueness needs a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.predicates import matches
from strata.functions.strings import present_items, strip
from strata.operators.dedup import repeat_number
from strata.operators.transforms import starts_with_pattern
from strata.operators.windows import HOT_ROWS

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
SEVERITIES = (ERROR, WARNING, INFO)

# Type names of rules and the column types that satisfy them; other names mean string.
TYPE_NAMES = {
    "string": (T.StringType,),
    "int": (T.IntegralType, T.BooleanType),
    "float": (T.NumericType, T.BooleanType),
    "bool": (T.BooleanType,),
    "list": (T.ArrayType,),
    "dict": (T.StructType, T.MapType),
}
# Message texts; {field} and the limits are filled in, {value} is the failed value.
MESSAGES = {
    "required": "Field '{field}' is required but missing or empty",
    "type_check": "Field '{field}' expected {expected}, got {actual}",
    "not_numeric": "Field '{field}' value '{value}' is not numeric",
    "below": "Field '{field}' value {value} is below minimum {limit}",
    "beyond": "Field '{field}' value {value} exceeds maximum {limit}",
    "pattern": "Field '{field}' value '{value}' does not match pattern",
    "enum_check": "Field '{field}' value '{value}' not in allowed values",
    "custom": "Field '{field}': {text}",
    "unique": "Field '{field}' value '{value}' is not unique",
}


@dataclass(frozen=True)
class Rule:
    kind: str
    name: str
    severity: str = ERROR
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")


def required(name: str, severity: str = ERROR) -> Rule:
    return Rule("required", name, severity)


def type_check(name: str, expected: str, severity: str = ERROR) -> Rule:
    return Rule("type_check", name, severity, {"expected": expected})


def range_check(name: str, low: float | None = None, high: float | None = None, severity: str = ERROR) -> Rule:
    return Rule("range_check", name, severity, {"low": low, "high": high})


def pattern(name: str, regex: str, severity: str = ERROR) -> Rule:
    return Rule("pattern", name, severity, {"regex": regex})


def enum_check(name: str, allowed: Sequence[Any], severity: str = ERROR) -> Rule:
    return Rule("enum_check", name, severity, {"allowed": list(allowed)})


def custom(name: str, check: Callable[[Column], Column], message: str = "Custom validation failed", severity: str = ERROR) -> Rule:
    """``check`` maps the value Column to a boolean Column; false or null fails, a null value passes."""
    return Rule("custom", name, severity, {"check": check, "message": message})


def unique(name: str, severity: str = ERROR) -> Rule:
    return Rule("unique", name, severity)


def business(name: str, condition: Callable[[DataFrame], Column] | Column, message: str, severity: str = ERROR) -> Rule:
    """Rule over the whole row; false or null fails. A condition that cannot be decided is always an error."""
    return Rule("business", name, severity, {"condition": condition, "message": message})


def from_schema(spec: Mapping[str, Mapping[str, Any]]) -> list[Rule]:
    """Rules of a ``{field: {required, type, min, max, pattern, enum}}`` description."""
    rules: list[Rule] = []
    for name, entry in spec.items():
        if entry.get("required"):
            rules.append(required(name))
        if "type" in entry:
            rules.append(type_check(name, entry["type"]))
        if "min" in entry or "max" in entry:
            rules.append(range_check(name, entry.get("min"), entry.get("max")))
        if "pattern" in entry:
            rules.append(pattern(name, entry["pattern"]))
        if "enum" in entry:
            rules.append(enum_check(name, entry["enum"]))
    return rules


def _message(kind: str, shown: Column, **parts: object) -> Column:
    """Text of a message with the failed value put in per row."""
    before, _, after = MESSAGES[kind].partition("{value}")
    texts = [F.lit(t.format(**parts)) for t in (before, after)]
    return F.concat(texts[0], shown, texts[1]) if "{value}" in MESSAGES[kind] else texts[0]


def _failure(df: DataFrame, rule: Rule, marker: str | None) -> Column:
    """Struct for a failed rule, null for a passed one. An absent column counts as null."""
    known = rule.name in df.columns
    value = F.col(rule.name) if known else F.lit(None).cast("string")
    kind = df.schema[rule.name].dataType if known else T.StringType()
    shown = value.cast("string")
    severity: Column = F.lit(rule.severity)
    p = rule.params
    if rule.kind == "required":
        failed = value.isNull() | (strip(value) == "") if isinstance(kind, T.StringType) else value.isNull()
        message = _message("required", shown, field=rule.name)
    elif rule.kind == "type_check":
        good = isinstance(kind, TYPE_NAMES.get(p["expected"], (T.StringType,)))
        failed = F.lit(False) if good else value.isNotNull()
        message = _message("type_check", shown, field=rule.name, expected=p["expected"], actual=kind.simpleString())
    elif rule.kind == "range_check":
        number = value.cast("double") if isinstance(kind, T.NumericType) else value.try_cast("double")
        low, high = p["low"], p["high"]
        below = F.lit(False) if low is None else number < low
        beyond = F.lit(False) if high is None else number > high
        failed = value.isNotNull() & (number.isNull() | below | beyond)
        message = (
            F.when(number.isNull(), _message("not_numeric", shown, field=rule.name))
            .when(below, _message("below", shown, field=rule.name, limit=low))
            .otherwise(_message("beyond", shown, field=rule.name, limit=high))
        )
    elif rule.kind == "pattern":
        failed = ~starts_with_pattern(value, p["regex"]) if isinstance(kind, T.StringType) else F.lit(False)
        message = _message("pattern", shown, field=rule.name)
    elif rule.kind == "enum_check":
        failed = value.isNotNull() & ~matches(value, [a for a in p["allowed"] if a is not None], kind)
        message = _message("enum_check", shown, field=rule.name)
    elif rule.kind == "custom":
        failed = value.isNotNull() & ~F.coalesce(p["check"](value), F.lit(False))
        message = _message("custom", shown, field=rule.name, text=p["message"])
    elif rule.kind == "unique":
        failed = value.isNotNull() & (F.col(marker) > 1)
        message = _message("unique", shown, field=rule.name)
    elif rule.kind == "business":
        condition = p["condition"] if isinstance(p["condition"], Column) else p["condition"](df)
        failed = ~F.coalesce(condition, F.lit(False))
        message = F.when(condition.isNull(), F.lit("Rule could not be evaluated")).otherwise(F.lit(p["message"]))
        severity = F.when(condition.isNull(), F.lit(ERROR)).otherwise(F.lit(rule.severity))
        shown = F.lit(None).cast("string")
    else:
        raise ValueError(f"unknown rule kind {rule.kind!r}")
    label = rule.name if rule.kind == "business" else rule.kind
    column = F.lit(None).cast("string") if rule.kind == "business" else F.lit(rule.name)
    return F.when(
        F.coalesce(failed, F.lit(False)),
        F.struct(
            F.lit(label).alias("rule_name"), column.alias("field_name"), severity.alias("severity"),
            message.alias("message"), shown.alias("failed_value"),
        ),
    )


def checked(df: DataFrame, rules: Sequence[Rule], order_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_failures`` (array of structs, rule order, uniqueness last) and ``_is_valid`` (no error)."""
    plain = [r for r in rules if r.kind != "unique"]
    marked, markers = df, {}
    for i, rule in enumerate(r for r in rules if r.kind == "unique"):
        if rule.name in df.columns:
            markers[f"__u{i}"] = rule
            marked = repeat_number(marked, rule.name, order_by or [c for c in df.columns if c != rule.name], f"__u{i}", hot_rows=hot_rows)
    items = [_failure(df, r, None) for r in plain] + [_failure(df, r, m) for m, r in markers.items()]
    failures = present_items(*items) if items else F.array().cast(
        "array<struct<rule_name:string,field_name:string,severity:string,message:string,failed_value:string>>"
    )
    result = marked.withColumn("_failures", failures).drop(*markers)
    return result.withColumn("_is_valid", ~F.exists("_failures", lambda f: f["severity"] == ERROR))


def failures(df: DataFrame, rules: Sequence[Rule], id_field: str, order_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per failed rule and record."""
    rows = checked(df, rules, order_by or [id_field], hot_rows)
    return rows.select(F.col(id_field).cast("string").alias("record_id"), F.explode("_failures").alias("f")).select("record_id", "f.*")


def report(df: DataFrame, rules: Sequence[Rule], order_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: records by validity and failures by severity (notices are not counted)."""
    rows = checked(df, rules, order_by, hot_rows)

    def of(severity: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("_failures", lambda f: f["severity"] == severity))), F.lit(0)).cast("bigint")

    total, valid = F.count(F.lit(1)), F.count_if(F.col("_is_valid"))
    return rows.agg(
        total.alias("total_records"), valid.alias("valid_records"), (total - valid).alias("invalid_records"),
        F.when(total > 0, F.round(valid / total, 4)).otherwise(0.0).alias("validity_rate"),
        of(ERROR).alias("error_count"), of(WARNING).alias("warning_count"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_constraint(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a check constraint; like in SQL an unknown outcome passes."""
    return df.where(~F.coalesce(condition, F.lit(True)))


# The rule sets of the four domains and the rule catalogue.
_EMAIL = r"^[\w\.-]+@[\w\.-]+\.\w+$"
HEALTH_RULES = [
    required("patient_id"),
    pattern("patient_id", r"^PAT\d{8}$"),
    required("first_name"),
    required("last_name"),
    required("date_of_birth"),
    enum_check("gender", ["M", "F", "O", "U"], WARNING),
    pattern("email", _EMAIL, WARNING),
    range_check("blood_pressure_systolic", 60, 250, WARNING),
    range_check("blood_pressure_diastolic", 40, 150, WARNING),
    range_check("heart_rate", 30, 220, WARNING),
]
FINANCE_RULES = [
    required("account_number"),
    pattern("account_number", r"^ACC\d{10}$"),
    required("customer_id"),
    required("account_type"),
    enum_check("account_type", ["CHECKING", "SAVINGS", "MONEY_MARKET", "CD", "BROKERAGE", "CREDIT_CARD"]),
    enum_check("currency", ["USD", "EUR", "GBP", "JPY", "CNY"]),
    enum_check("status", ["ACTIVE", "FROZEN", "CLOSED", "DORMANT"]),
    range_check("aml_risk_score", 0, 100, WARNING),
]
TECH_RULES = [
    required("server_id"),
    pattern("server_id", r"^SRV-[A-Z]{2}-\d{4}$"),
    required("hostname"),
    required("environment"),
    enum_check("environment", ["PROD", "STAGING", "DEV", "QA"]),
    enum_check("status", ["RUNNING", "STOPPED", "MAINTENANCE", "DEGRADED", "FAILED"]),
    range_check("cpu_usage_pct", 0, 100, WARNING),
    range_check("memory_used_pct", 0, 100, WARNING),
]
UNIVERSITY_RULES = [
    required("student_id"),
    pattern("student_id", r"^STU\d{8}$"),
    required("first_name"),
    required("last_name"),
    required("email"),
    pattern("email", _EMAIL),
    range_check("gpa", 0.0, 4.0),
    range_check("credits_earned", 0, 200),
    enum_check("enrollment_status", ["ACTIVE", "GRADUATED", "SUSPENDED", "WITHDRAWN", "ON_LEAVE"]),
    enum_check("academic_level", ["FRESHMAN", "SOPHOMORE", "JUNIOR", "SENIOR", "GRADUATE"]),
]
DOMAIN_RULES = {"health": HEALTH_RULES, "finance": FINANCE_RULES, "tech": TECH_RULES, "university": UNIVERSITY_RULES}
CATALOGUE = {
    "health": {
        "patient_id": {"type": "string", "pattern": r"^PAT\d{8}$"},
        "ssn": {"type": "string", "pattern": r"^\d{3}-\d{2}-\d{4}$", "pii": True},
        "blood_pressure_systolic": {"type": "int", "min": 60, "max": 250},
        "blood_pressure_diastolic": {"type": "int", "min": 40, "max": 150},
        "heart_rate": {"type": "int", "min": 30, "max": 220},
    },
    "finance": {
        "account_number": {"type": "string", "pattern": r"^ACC\d{10}$"},
        "amount": {"type": "decimal", "min": -1e12, "max": 1e12},
        "currency": {"type": "string", "enum": ["USD", "EUR", "GBP", "JPY", "CNY"]},
        "transaction_type": {"type": "string", "enum": ["CREDIT", "DEBIT", "TRANSFER"]},
    },
    "tech": {
        "server_id": {"type": "string", "pattern": r"^SRV-[A-Z]{2}-\d{4}$"},
        "cpu_usage": {"type": "float", "min": 0, "max": 100},
        "memory_usage": {"type": "float", "min": 0, "max": 100},
        "response_time_ms": {"type": "float", "min": 0, "max": 60000},
    },
    "university": {
        "student_id": {"type": "string", "pattern": r"^STU\d{8}$"},
        "gpa": {"type": "float", "min": 0.0, "max": 4.0},
        "credits": {"type": "int", "min": 0, "max": 200},
        "enrollment_status": {"type": "string", "enum": ["ACTIVE", "GRADUATED", "SUSPENDED", "WITHDRAWN"]},
    },
}
THRESHOLDS = {
    "completeness_threshold": 0.95,
    "uniqueness_threshold": 1.0,
    "validity_threshold": 0.98,
    "timeliness_hours": 24,
    "consistency_threshold": 0.99,
}
