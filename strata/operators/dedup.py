"""De-duplication and duplicate counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import named
from strata.operators.windows import HOT_ROWS, hot_groups, split_hot, tie_columns, window

KEEP = ("first", "last", "none")
# Texts longer than this are compared by their SHA-256 digest.
DIGEST_ABOVE = 64


def compact_key(df: DataFrame, name: str) -> Column:
    """A text column as a key: itself while short, else a digest over the whole text.

    Digests carry a mark that makes them longer than any short text, so the two cannot meet. A long
    text that is only compared, and not part of the result, then never leaves its map task.
    """
    value = named(name)
    if not isinstance(df.schema[name].dataType, T.StringType):
        return value
    return F.when(F.length(value) > DIGEST_ABOVE, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)


def deduplicate(df: DataFrame, key_columns: Sequence[str], order_by: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One whole row per key: the first or last by ``order_by``; the other columns break ties.

    Null keys compare equal; no keys leaves the input as it is; ``none`` acts as ``first``.
    Because only row number 1 is kept, Spark limits every group to one row before the shuffle
    (WindowGroupLimit), so a key with a third of all rows sends one row per map task.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    if not key_columns:
        return df
    order = [*order_by, *tie_columns(df, [*key_columns, *order_by])]
    sides = [named(c).desc_nulls_last() if keep == "last" else named(c).asc_nulls_first() for c in order] or [F.lit(1)]
    keys = [compact_key(df, c) for c in key_columns]
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*sides)))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def top_n_per_group(df: DataFrame, group_by: Sequence[str], order: Sequence[object], n: int, name: str = "rank_in_group") -> DataFrame:
    """First ``n`` rows of each group; limited before the shuffle like :func:`deduplicate` (by Spark's default, for n up to 1000)."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group_by).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


def repeat_number(df: DataFrame, key: str, order_by: Sequence[str], name: str, tie_break: Sequence[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rows that share a non-null key 1, 2, 3 … in order; every row is kept, null keys get 1.

    Keys are counted first, which moves hashes only. Just the rows with a repeated key are shuffled and
    sorted; all others, and the rows without a key, pass through with number 1.
    """
    present, absent = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull()).withColumn(name, F.lit(1))
    repeated, _ = hot_groups(present, [key], 1)
    if repeated is None:
        return df.withColumn(name, F.lit(1))
    some, rest = split_hot(present, [key], repeated)
    numbered = window(some, [key], list(order_by), {name: {"function": "row_number"}}, tie_break, hot_rows)
    return numbered.unionByName(rest.withColumn(name, F.lit(1))).unionByName(absent)


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and surplus copies of whole rows.

    Rows are compared by a digest over all their columns in text form, times to the microsecond, so
    only digests are shuffled, and copies are counted before that.
    """
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    whole = F.sha2(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), exact), 256)
    copies = df.groupBy(whole.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def derived_dimension(df: DataFrame, key: str, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Distinct entities found in another table: first row per non-null, non-empty key."""
    kept = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(key, *[c for c in columns if c != key], *[c for c in order_by if c not in (key, *columns)])
    return deduplicate(kept, [key], order_by).select(key, *[c for c in columns if c != key])
