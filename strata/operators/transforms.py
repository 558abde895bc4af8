"""Whole-record steps: cleanse, enrich, validate, mask, cast, stamp. Chain them with ``DataFrame.transform``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import casts, strings
from strata.functions.predicates import matches, threshold
from strata.operators.joins import lookup


def internal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_")]


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*internal_columns(df))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def project_to(df: DataFrame, target: Iterable[str]) -> DataFrame:
    wanted = set(target)
    return df.select(*[c for c in df.columns if c in wanted])


def cleanse(
    df: DataFrame,
    trim_strings: bool = True,
    null_values: Sequence[str] = strings.NULL_TOKENS,
    lowercase_columns: Sequence[str] = (),
    uppercase_columns: Sequence[str] = (),
    date_columns: Mapping[str, str] | None = None,
    numeric_columns: Sequence[str] = (),
    critical_columns: Sequence[str] = (),
    keep_raw: bool = False,
) -> DataFrame:
    """Trim, blank out null tokens, fix case, parse dates and numbers in one projection.

    A text that is no date or number becomes null; ``keep_raw`` keeps it in ``<column>_raw``.
    Rows with a null in a critical column are dropped.
    """
    date_columns = dict(date_columns or {})
    out: list[Column] = []
    for field in df.schema.fields:
        name, value, is_text = field.name, F.col(field.name), isinstance(field.dataType, T.StringType)
        if is_text and trim_strings:
            value = strings.strip(value)
        if is_text:
            value = strings.null_if_token(value, list(null_values))
            if name in lowercase_columns:
                value = F.lower(value)
            elif name in uppercase_columns:
                value = F.upper(value)
        raw = value
        if name in date_columns:
            value = casts.parse_timestamp(value, date_columns[name]) if is_text else value.cast("timestamp")
        elif name in numeric_columns:
            value = casts.to_number(value)
        out.append(value.alias(name))
        if keep_raw and (name in date_columns or name in numeric_columns):
            out.append(raw.alias(f"{name}_raw"))
    cleaned = df.select(*out)
    return cleaned.dropna(subset=list(critical_columns)) if critical_columns else cleaned


def _null_on_failure(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column whose failing rows are null: how expressions fail is settled when they are resolved."""
    conf = df.sparkSession.conf
    strict = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        return df.withColumn(name, value)
    finally:
        conf.set("spark.sql.ansi.enabled", strict)


def enrich(
    df: DataFrame,
    default_values: Mapping[str, Any] | None = None,
    computed_fields: Mapping[str, Column | Callable[[DataFrame], Column]] | None = None,
    lookup_tables: Mapping[str, tuple[DataFrame, str, str]] | None = None,
    run_ts: str | None = None,
    job_id: str | None = None,
) -> DataFrame:
    """Defaults, then computed fields (each sees the earlier ones), then lookups, then the run stamp.

    A computed field that fails on a row, by a cast, a division by zero or an index out of range, is null there;
    whole numbers beyond their type wrap around, so compute those as decimals.
    """
    result = df
    for name, default in (default_values or {}).items():
        value = F.coalesce(F.col(name), F.lit(default)) if name in result.columns else F.lit(default)
        result = result.withColumn(name, value)
    for name, rule in (computed_fields or {}).items():
        result = _null_on_failure(result, name, rule if isinstance(rule, Column) else rule(result))
    for field, (table, key, value_name) in (lookup_tables or {}).items():
        if field in result.columns:
            result = lookup(result, field, table, key, value_name)
    if run_ts is not None:
        result = result.withColumn("_etl_timestamp", F.lit(run_ts).cast("timestamp"))
    if job_id is not None:
        result = result.withColumn("_etl_job_id", F.lit(job_id))
    return result


# Type names of field rules and the Spark types that satisfy them.
RULE_TYPES = {
    "string": (T.StringType,),
    "int": (T.IntegralType, T.BooleanType),
    "float": (T.NumericType, T.BooleanType),
}
# Message texts of field rules.
RULE_MESSAGES = {
    "required": "{field} is required",
    "string": "{field} must be a string",
    "int": "{field} must be an integer",
    "float": "{field} must be a number",
    "min": "{field} must be >= {limit}",
    "max": "{field} must be <= {limit}",
    "pattern": "{field} does not match pattern {limit}",
    "enum": "{field} must be one of {limit}",
}


def field_errors(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> Column:
    """Array of messages, in rule order; a missing required field skips its other checks."""
    items: list[Column] = []

    def fail(name: str, kind: str, condition: Column, limit: object = None) -> None:
        items.append(F.when(condition, F.lit(RULE_MESSAGES[kind].format(field=name, limit=limit))))

    for name, rule in rules.items():
        known = name in df.columns
        value = F.col(name) if known else F.lit(None).cast("string")
        if rule.get("required"):
            fail(name, "required", value.isNull())
        if not known:
            continue
        kind, expected = df.schema[name].dataType, rule.get("type")
        if expected in RULE_TYPES and not isinstance(kind, RULE_TYPES[expected]):
            fail(name, expected, value.isNotNull())
        if "min" in rule:
            fail(name, "min", value.isNotNull() & ~threshold(value, "gte", rule["min"]), rule["min"])
        if "max" in rule:
            fail(name, "max", value.isNotNull() & ~threshold(value, "lte", rule["max"]), rule["max"])
        if "pattern" in rule and isinstance(kind, T.StringType):
            fail(name, "pattern", ~starts_with_pattern(value, rule["pattern"]), rule["pattern"])
        if "enum" in rule:
            fail(name, "enum", value.isNotNull() & ~matches(value, [a for a in rule["enum"] if a is not None], kind), list(rule["enum"]))
    return strings.present_items(*items) if items else F.array().cast("array<string>")


def starts_with_pattern(value: Column, pattern: str) -> Column:
    """True when the pattern matches at the start of the text (the end is free); its classes cover all alphabets."""
    re.compile(pattern)
    return value.rlike(f"(?U)^(?:{pattern})")


def validate(df: DataFrame, rules: Mapping[str, Mapping[str, Any]], reject_invalid: bool = False) -> DataFrame:
    """Tag rows with ``_is_valid`` and ``_validation_errors``, or keep the valid ones only."""
    tagged = df.withColumn("_validation_errors", field_errors(df, rules)).withColumn("_is_valid", F.size("_validation_errors") == 0)
    return tagged.where("_is_valid").drop("_validation_errors") if reject_invalid else tagged


def mask_pii(df: DataFrame, hash_columns: Sequence[str] = (), mask_columns: Mapping[str, str] | None = None, redact_columns: Sequence[str] = ()) -> DataFrame:
    """Hash (and blank) first, then mask, then redact; columns that do not exist are passed over."""
    result = df
    hashed = [c for c in hash_columns if c in df.columns]
    if hashed:
        result = result.withColumns({f"{c}_hash": strings.pii_hash(c) for c in hashed})
        result = result.withColumns({
            c: F.when(F.char_length(F.col(c).cast("string")) > 0, F.lit(None)).otherwise(F.col(c)) for c in hashed
        })
    masked = {c: strings.mask_as(c, kind) for c, kind in (mask_columns or {}).items() if c in df.columns}
    if masked:
        result = result.withColumns(masked)
    redacted = {c: F.lit(strings.REDACTED) for c in redact_columns if c in df.columns}
    return result.withColumns(redacted) if redacted else result


def typecast(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return casts.cast_columns(df, dict(mapping))


def add_audit(df: DataFrame, run_ts: str, user: str | None = None, reason: str | None = None) -> DataFrame:
    """Creation, change and deletion marks of a new row."""
    stamp, text = F.lit(run_ts).cast("timestamp"), F.lit(None).cast("string")
    return df.withColumns({
        "created_at": stamp, "updated_at": stamp, "created_by": F.lit(user).cast("string"), "updated_by": F.lit(user).cast("string"),
        "is_deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp"), "deleted_by": text,
        "version": F.lit(1), "change_reason": F.lit(reason).cast("string"),
    })


def add_lineage(df: DataFrame, source_system: str, job_id: str, run_ts: str, source_file: Column | None = None, score: Column | None = None) -> DataFrame:
    """Where a row came from; pass ``F.input_file_name()`` as ``source_file`` right after a file scan."""
    return df.withColumns({
        "source_system": F.lit(source_system),
        "source_file": F.lit(None).cast("string") if source_file is None else source_file,
        "ingestion_timestamp": F.lit(run_ts).cast("timestamp"),
        "etl_job_id": F.lit(job_id),
        "data_quality_score": F.lit(None).cast("int") if score is None else score,
    })


def soft_delete(df: DataFrame, condition: Column, run_ts: str, user: str) -> DataFrame:
    """Mark the rows that meet the condition; no row is removed."""
    hit = F.coalesce(condition, F.lit(False))

    def previous(name: str, kind: str, default: object) -> Column:
        return F.col(name) if name in df.columns else F.lit(default).cast(kind)

    return df.withColumns({
        "is_active": F.when(hit, F.lit(False)).otherwise(previous("is_active", "boolean", True)),
        "is_deleted": F.when(hit, F.lit(True)).otherwise(previous("is_deleted", "boolean", False)),
        "deleted_at": F.when(hit, F.lit(run_ts).cast("timestamp")).otherwise(previous("deleted_at", "timestamp", None)),
        "deleted_by": F.when(hit, F.lit(user)).otherwise(previous("deleted_by", "string", None)),
    })


def in_batches(df: DataFrame, fn: Callable[[Any], Any], schema: T.StructType | str) -> DataFrame:
    """Run a function over Arrow batches as pandas frames, for logic that no Column expression covers."""
    def run(batches: Iterable[Any]) -> Iterable[Any]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
