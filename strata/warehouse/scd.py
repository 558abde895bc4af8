"""Upsert and slowly changing dimensions as join rewrites.

Plain files have no MERGE, so each function returns the complete new version of the table together
with an ``_action`` column. Write the result to a new folder, never over the folder being read.
Rows with a null key, on either side, never match (as in SQL) and stay out of the join, so they cannot
pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions._cols import named, quoted
from strata.operators.dedup import deduplicate
from strata.operators.windows import HOT_ROWS, number_rows, window
from strata.session import scratch_path

ACTION = "_action"


def _all_present(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & named(k).isNotNull()
    return condition


def _aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source with exactly the target's columns, in the target's types."""
    return source.select(*[
        (named(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields
    ])


def _pair(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of the two tables as structs ``t`` and ``s``."""
    left = target.select(F.struct("*").alias("t"), *[named(k).alias(f"__t_{k}") for k in keys])
    right = source.select(F.struct("*").alias("s"), *[named(k).alias(f"__s_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & (named(f"__t_{k}") == named(f"__s_{k}"))
    return left.join(right, condition, "full_outer").select("t", "s")


def upsert(target: DataFrame, source: DataFrame, key_columns: Sequence[str], update_columns: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Update matched rows, insert the others. The last source row per key wins."""
    keys = list(key_columns)
    present = source.where(_all_present(keys))
    latest = deduplicate(present, keys, order_by, keep="last")
    changed = [c for c in (update_columns or source.columns) if c not in keys and c in target.columns and c in source.columns]
    pairs = _pair(target.where(_all_present(keys)), _aligned(latest, target), keys)
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    columns = []
    for c in target.columns:
        updated = F.col(f"s.{quoted(c)}") if c in changed else F.col(f"t.{quoted(c)}")
        columns.append(F.when(has_t & has_s, updated).when(has_s, F.col(f"s.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}")).alias(c))
    action = F.when(has_t & has_s, "updated").when(has_s, "inserted").otherwise("kept")
    merged = pairs.select(*columns, action.alias(ACTION))
    nulls = _aligned(source.where(~_all_present(keys)), target).withColumn(ACTION, F.lit("inserted"))
    return merged.unionByName(nulls).unionByName(target.where(~_all_present(keys)).withColumn(ACTION, F.lit("kept")))


def action_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy(ACTION).agg(F.count(F.lit(1)).alias("n"))


def assign_surrogate_keys(df: DataFrame, surrogate: str, order_by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Fill null surrogate keys with the numbers after the highest one; existing keys never change.

    The table is evaluated once, into the shared folder; highest key and number of new rows come from
    there with one aggregate over one column.
    """
    path = scratch_path(df.sparkSession, "keyed")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    known = df.where(F.col(surrogate).isNotNull())
    highest, missing = df.agg(F.coalesce(F.max(surrogate), F.lit(0)), F.count_if(F.col(surrogate).isNull())).first()
    fresh = number_rows(df.where(F.col(surrogate).isNull()).drop(surrogate), order_by, surrogate, hot_rows=hot_rows, rows=missing)
    numbered = fresh.withColumn(surrogate, (F.col(surrogate) + F.lit(highest)).cast("bigint"))
    return known.withColumn(surrogate, F.col(surrogate).cast("bigint")).unionByName(numbered)


def scd1(target: DataFrame, source: DataFrame, natural_key: Sequence[str], surrogate: str, order_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Overwrite matched rows under their surrogate key, add new ones with new keys."""
    columns = [c for c in source.columns if c not in natural_key and c != surrogate]
    merged = upsert(target, source, natural_key, columns, order_by)
    return assign_surrogate_keys(merged, surrogate, list(natural_key), hot_rows)


def scd2(
    target: DataFrame,
    source: DataFrame,
    business_key: Sequence[str],
    as_of: str,
    tracked_columns: Sequence[str] | None = None,
    effective: str = "effective_date",
    end: str = "end_date",
    current: str = "is_current",
    surrogate: str | None = None,
    order_by: Sequence[str] = (),
    chain: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Close the current version of changed rows and add the new one; loading a batch again changes nothing.

    ``tracked_columns`` (default: all but keys and version columns) decide, null-safely, what counts as
    a change. A key repeated in one batch keeps its last row by ``order_by``; with ``chain`` every
    change inside the batch becomes a version of its own, the earlier ones closed at ``as_of``.
    ``_action`` is ``history``, ``untouched``, ``unchanged``, ``expired``, ``updated``, ``inserted``
    (or ``superseded`` for closed versions of a chain).
    """
    keys = list(business_key)
    special = {effective, end, current, surrogate}
    tracked = list(tracked_columns or [c for c in target.columns if c not in keys and c not in special])
    stamp = F.lit(as_of).cast(target.schema[effective].dataType)
    history = target.where(~F.coalesce(F.col(current), F.lit(False)))
    open_rows = target.where(F.coalesce(F.col(current), F.lit(False)))
    keyless, open_rows = open_rows.where(~_all_present(keys)), open_rows.where(_all_present(keys))
    present = source.where(_all_present(keys))
    if chain:
        batch = _batch_versions(present, keys, tracked, order_by, hot_rows)
        heads, rest = batch.where("__first"), batch.where("NOT __first")
    else:
        heads, rest = deduplicate(present, keys, order_by, keep="last").withColumn("__last", F.lit(True)), None

    fresh_fields = {effective: stamp, end: F.lit(None).cast(target.schema[end].dataType), current: F.lit(True)}
    if surrogate:
        fresh_fields[surrogate] = F.lit(None).cast(target.schema[surrogate].dataType)

    def row(origin: str, action: Column, changes: dict[str, Column]) -> Column:
        fields = [(changes[f.name] if f.name in changes else F.col(f"{origin}.{quoted(f.name)}")).cast(f.dataType).alias(f.name) for f in target.schema.fields]
        return F.struct(*fields, action.alias(ACTION))

    aligned = _aligned(heads, target)
    pairs = _pair(open_rows, aligned.withColumn("__last", F.lit(True)) if not chain else _with_flag(heads, target), keys)
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    differs = F.lit(False)
    for c in tracked:
        differs = differs | ~F.col(f"t.{quoted(c)}").eqNullSafe(F.col(f"s.{quoted(c)}"))
    closed = {end: stamp, current: F.lit(False)}
    last = F.col("s.__last")
    new_row = {**fresh_fields, end: F.when(~last, stamp), current: last}
    new_action = F.when(~last, "superseded").when(has_t, "updated").otherwise("inserted")
    # A key whose only change comes later in the batch keeps its head out but must close the open row.
    closes = has_t & has_s & (differs | ~last)
    versions = F.array_compact(F.array(
        F.when(has_t & ~has_s, row("t", F.lit("untouched"), {})),
        F.when(has_t & has_s & ~closes, row("t", F.lit("unchanged"), {})),
        F.when(closes, row("t", F.lit("expired"), closed)),
        F.when(has_s & (~has_t | differs), row("s", new_action, new_row)),
    ))
    result = pairs.select(F.explode(versions).alias("v")).select("v.*")
    result = history.withColumn(ACTION, F.lit("history")).unionByName(result).unionByName(keyless.withColumn(ACTION, F.lit("untouched")))
    nulls = _aligned(source.where(~_all_present(keys)), target).withColumns(fresh_fields).withColumn(ACTION, F.lit("inserted"))
    result = result.unionByName(nulls)
    if rest is not None:
        later = _with_flag(rest, target)
        later = later.withColumns({**fresh_fields, end: F.when(~F.col("__last"), stamp), current: F.col("__last")})
        later = later.withColumn(ACTION, F.when(F.col("__last"), "updated").otherwise("superseded")).drop("__last")
        result = result.unionByName(later)
    return assign_surrogate_keys(result, surrogate, [*keys, effective], hot_rows) if surrogate else result


def _with_flag(rows: DataFrame, target: DataFrame) -> DataFrame:
    return rows.select(*[
        (named(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields
    ], "__last")


def _batch_versions(source: DataFrame, keys: list[str], tracked: list[str], order_by: Sequence[str], hot_rows: int) -> DataFrame:
    """Rows of a batch that differ from the row before them; ``__first`` and ``__last`` mark the ends per key."""
    packed = source.withColumn("__state", F.struct(*[c for c in tracked if c in source.columns]))
    before = window(packed, keys, list(order_by), {"__n": {"function": "row_number"}, "__prev": {"function": "lag", "column": "__state"}}, hot_rows=hot_rows)
    changes = before.where((F.col("__n") == 1) | ~F.col("__state").eqNullSafe(F.col("__prev"))).drop("__prev")
    ends = window(changes, keys, ["__n"], {"__next": {"function": "lead", "column": "__n"}}, [], hot_rows)
    return ends.withColumns({"__first": F.col("__n") == 1, "__last": F.col("__next").isNull()}).drop("__n", "__next", "__state")


def scd2_counts(merged: DataFrame) -> DataFrame:
    """Inserted, updated and unchanged source records of a load."""
    return merged.agg(*[
        F.count_if(F.col(ACTION).isin(*names)).alias(label)
        for label, names in (("inserted", ["inserted"]), ("updated", ["updated", "superseded"]), ("unchanged", ["unchanged"]))
    ])
