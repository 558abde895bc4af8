"""Tolerant type casts: a value that cannot be converted becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import ColumnLike, as_col

# Texts read as true.
TRUE_TEXTS = ("true", "1", "yes")
# Day-time directives and the pattern letters that mean the same.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD",
}
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def datetime_pattern(directives: str) -> str:
    """``%Y-%m-%d`` style format as a Spark pattern; letters outside directives are quoted."""
    out, i = [], 0
    while i < len(directives):
        pair = directives[i : i + 2]
        if pair in DIRECTIVES:
            out.append(DIRECTIVES[pair])
            i += 2
            continue
        char = directives[i]
        if char == "%":
            raise ValueError(f"unsupported date directive {pair!r}")
        out.append(f"'{char}'" if char.isalpha() else char)
        i += 1
    return "".join(out)


def parse_timestamp(value: ColumnLike, directives: str) -> Column:
    return F.try_to_timestamp(as_col(value).cast("string"), F.lit(datetime_pattern(directives)))


def to_number(value: ColumnLike) -> Column:
    return as_col(value).try_cast("double")


def cast_to(value: ColumnLike, target: str, source: T.DataType = T.StringType(), decimal: str = "decimal(38,18)") -> Column:
    """Cast to ``int float decimal string bool date datetime``; int truncates toward zero."""
    column = as_col(value)
    if target == "int":
        if isinstance(source, T.IntegralType):
            return column.cast("bigint")
        return column.try_cast("double").try_cast("bigint")
    if target == "float":
        return column.try_cast("double")
    if target == "decimal":
        return column.try_cast(decimal)
    if target == "string":
        return column.cast("string")
    if target in ("bool", "boolean"):
        if isinstance(source, T.BooleanType):
            return column
        if isinstance(source, T.NumericType):
            return column != 0
        return F.lower(column).isin(*TRUE_TEXTS)
    if target in ("date", "datetime"):
        kind = "date" if target == "date" else "timestamp"
        if isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return column.cast(kind)
        return F.when(column.rlike(ISO_DATE), column.try_cast(kind))
    raise ValueError(f"unknown cast target {target!r}")


def safe_cast(value: ColumnLike, target: str, default: object = None, source: T.DataType = T.StringType()) -> Column:
    return F.coalesce(cast_to(value, target, source), F.lit(default))


def cast_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Apply :func:`cast_to` to the columns that exist."""
    present = {c: t for c, t in mapping.items() if c in df.columns}
    return df.withColumns({c: cast_to(c, t, df.schema[c].dataType) for c, t in present.items()})
