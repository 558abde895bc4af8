"""Window metrics that also hold when one group is far larger than a task can sort.

Groups are counted first (one aggregate over a 64-bit hash of the group key). If none is larger than
``hot_rows``, an ordinary Spark window does the work; both ways give the same values, sums of doubles too (``exact_sum``). Rows of larger groups are instead range-partitioned
by group and order into many segments (beyond ``SEGMENTS`` only ones of ``NUMBERED_ROWS`` rows or more), written once to the checkpoint folder, windowed inside their
segment and completed with what the earlier (or later) segments of the group carry over. The carried
rows are one per group and segment, so they stay small whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import named, quoted
from strata.operators.exact_sum import Doubles, Whole, accumulators, number
from strata.session import scratch_path, shared_dir

HOT_ROWS = 2_000_000
NUMBERED_ROWS = 250_000
#: Segments at most, unless they would hold more than ``NUMBERED_ROWS`` rows: the driver hears of each, and samples rows to place them.
SEGMENTS = 256

SEGMENT, SERIAL = "__w_segment", "__w_serial"
OFFSET_FUNCTIONS = ("lag", "lead")
SUM_FUNCTIONS = ("running_sum", "running_avg")
FUNCTIONS = ("row_number", "rank", *OFFSET_FUNCTIONS, *SUM_FUNCTIONS)


def tie_columns(df: DataFrame, used: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in used and _orderable(f.dataType)]


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)


def _check(metrics: Mapping[str, Mapping[str, Any]]) -> None:
    for name, spec in metrics.items():
        if spec.get("function") not in FUNCTIONS:
            raise ValueError(f"window metric {name!r}: function must be one of {FUNCTIONS}")


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """Table of the hashes of all groups above ``hot_rows`` and the rows they hold; (None, 0) when there are none.

    Groups are told apart by hash only. Two groups with one hash travel together, which costs time
    but changes no result, because the rows are later grouped by their real keys.
    """
    counts = df.select(F.xxhash64(*map(quoted, keys)).alias("__w_hot")).groupBy("__w_hot").count().where(F.col("count") > hot_rows)
    path = scratch_path(df.sparkSession, "hot-groups")
    counts.write.parquet(path)
    listed = df.sparkSession.read.schema("`__w_hot` bigint, `count` bigint").parquet(path)
    rows = listed.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return (listed.select("__w_hot"), rows) if rows else (None, 0)


def split_hot(df: DataFrame, keys: Sequence[str], listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the listed groups, other rows). Spark broadcasts the list where it has measured it to be small."""
    tagged = df.withColumn("__w_hash", F.xxhash64(*map(quoted, keys)))
    condition = tagged["__w_hash"] == listed["__w_hot"]
    return tagged.join(listed, condition, "left_semi").drop("__w_hash"), tagged.join(listed, condition, "left_anti").drop("__w_hash")


def window(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str] | str,
    metrics: Mapping[str, Mapping[str, Any]],
    tie_break: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add window metrics ``{name: {"function", "column", "window"}}``.

    Ascending order, nulls first. ``tie_break`` (default: all other columns) makes the order total;
    pass ``[]`` when ``order_by`` is unique. ``rank`` follows SQL and ignores the tie-breakers.
    Running sums start from 0 and skip nulls and texts that are no numbers; running averages are null before the
    first value. Both are exact until they are rounded to a double; infinities and not-a-number add up as doubles do.
    ``rows`` saves counting the rows where there are no groups.
    """
    _check(metrics)
    if any(c.startswith("__w_") for c in df.columns):
        raise ValueError("column names must not start with __w_, which is kept for work columns")
    keys = list(partition_by)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    tie = tie_columns(df, [*keys, *order]) if tie_break is None else list(tie_break)
    if not keys:
        rows = df.count() if rows is None else rows
        return _segmented(df, keys, order, tie, metrics, _segments(rows, hot_rows)) if rows > hot_rows else _plain(df, keys, order, tie, metrics)
    listed, rows = hot_groups(df, keys, hot_rows)
    if listed is None:
        return _plain(df, keys, order, tie, metrics)
    hot_part, rest = split_hot(df, keys, listed)
    done = _segmented(hot_part, keys, order, tie, metrics, max(2, _segments(rows, hot_rows)))
    return _plain(rest, keys, order, tie, metrics).unionByName(done)


def _segments(rows: int, hot_rows: int) -> int:
    """Segments of about ``hot_rows`` rows, or fewer and larger ones that a task can still sort."""
    return min(-(-rows // hot_rows), max(SEGMENTS, -(-rows // NUMBERED_ROWS)))


def number_rows(df: DataFrame, order_by: Sequence[str], name: str = "row_number", **kwargs: Any) -> DataFrame:
    """Dense numbers 1, 2, 3 … over the whole table; a task sorts at most ``NUMBERED_ROWS`` whole rows."""
    kwargs.setdefault("hot_rows", NUMBERED_ROWS)
    return window(df, [], order_by, {name: {"function": "row_number"}}, **kwargs)


def _plain(df: DataFrame, keys: list[str], order: list[str], tie: list[str], metrics: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    keys = [quoted(k) for k in keys]
    ranked = Window.partitionBy(*keys).orderBy(*[named(c).asc_nulls_first() for c in order])
    total = Window.partitionBy(*keys).orderBy(*[named(c).asc_nulls_first() for c in [*order, *tie]])
    how = accumulators(df, _summed(metrics))
    rows, run = df, total.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work: dict[str, Column] = {}
    for i, (c, kind) in enumerate(how.items()):  # the sums of all bins first, in one window; the doubles from them
        work |= {f"__w_s{i}_{k}": F.sum(v).over(run) for k, v in kind.parts(number(df, c)).items()} | {f"__w_c{i}": F.count(number(df, c)).over(run)}
    rows = df.withColumns(work) if work else df
    new = {name: _expression(spec, total, ranked, how) for name, spec in metrics.items()}
    return rows.withColumns(new).select(*[named(c) for c in dict.fromkeys([*df.columns, *new])])


def _summed(metrics: Mapping[str, Mapping[str, Any]]) -> list[str]:
    return sorted({m["column"] for m in metrics.values() if m["function"] in SUM_FUNCTIONS})


def _expression(spec: Mapping[str, Any], total: Any, ranked: Any, how: Mapping[str, Whole | Doubles]) -> Column:
    function, column, offset = spec["function"], spec.get("column"), int(spec.get("window", 1))
    if function == "row_number":
        return F.row_number().over(total)
    if function == "rank":
        return F.rank().over(ranked)
    if function == "lag":
        return F.lag(named(column), offset).over(total)
    if function == "lead":
        return F.lead(named(column), offset).over(total)
    i, kind = list(how).index(column), how[column]
    seen = F.col(f"__w_c{i}")
    value = kind.total({k: F.col(f"__w_s{i}_{k}") for k in kind.parts(F.lit(0.0))})
    return F.coalesce(value, F.lit(0.0)) if function == "running_sum" else F.when(seen > 0, value / seen)


def _segmented(
    df: DataFrame, keys: list[str], order: list[str], tie: list[str], metrics: Mapping[str, Mapping[str, Any]], segments: int
) -> DataFrame:
    shared_dir(df.sparkSession)
    columns = df.columns
    # The serial number separates rows that are equal in every column, so that even a group of
    # copies can be cut into segments. The checkpoint fixes segment and serial for both uses below.
    placed = (
        df.withColumn(SERIAL, F.monotonically_increasing_id())
        .repartitionByRange(segments, *map(named, keys), *[named(c).asc_nulls_first() for c in [*order, *tie]], SERIAL)
        .withColumn(SEGMENT, F.spark_partition_id())
        .checkpoint()
    )
    inner = [*map(quoted, keys), SEGMENT]
    local = Window.partitionBy(*inner).orderBy(*[named(c).asc_nulls_first() for c in [*order, *tie]], SERIAL)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = accumulators(placed, _summed(metrics))
    shifts = {n: m for n, m in metrics.items() if m["function"] in OFFSET_FUNCTIONS}
    with_rank = any(m["function"] == "rank" for m in metrics.values())

    carried = _carry(placed, keys, order, tie, sums, shifts, with_rank)
    work: dict[str, Column] = {"__w_n": F.row_number().over(local)}
    for i, (c, kind) in enumerate(sums.items()):
        work |= {f"__w_s{i}_{k}": F.sum(v).over(upto) for k, v in kind.parts(number(df, c)).items()}
        work[f"__w_c{i}"] = F.count(number(df, c)).over(upto)
    for name, spec in shifts.items():
        shift = F.lag if spec["function"] == "lag" else F.lead
        work[f"__w_v_{name}"] = shift(named(spec["column"]), int(spec.get("window", 1))).over(local)
    rows = placed.withColumns(work)
    if with_rank:
        rows = rows.withColumn("__w_tie", F.first("__w_n").over(Window.partitionBy(*inner, *map(quoted, order)).orderBy("__w_n")))

    left, right = rows.alias("l"), carried.alias("r")
    condition = F.col(f"l.{SEGMENT}") == F.col(f"r.{SEGMENT}")
    for k in keys:
        condition = condition & F.col(f"l.{quoted(k)}").eqNullSafe(F.col(f"r.{quoted(k)}"))
    joined = left.join(right, condition, "left")

    out: list[Column] = [F.col(f"l.{quoted(c)}") for c in columns]
    position = F.col("__w_n") + F.col("__w_before")
    for name, spec in metrics.items():
        function, n = spec["function"], int(spec.get("window", 1))
        if function == "row_number":
            value = position.cast("bigint")
        elif function == "rank":
            same = F.struct(*[F.col(f"l.{quoted(c)}") for c in order]).eqNullSafe(F.col("__w_first"))
            value = (F.col("__w_tie") + F.col("__w_before") - F.when(same, F.col("__w_tied")).otherwise(0)).cast("bigint")
        elif function == "lag":
            size = F.size(f"__w_t_{name}")
            value = F.when(F.col("__w_n") > n, F.col(f"__w_v_{name}")).otherwise(
                F.get(F.col(f"__w_t_{name}"), size - n + F.col("__w_n") - 1)["v"]
            )
        elif function == "lead":
            value = F.when(F.col("__w_n") + n <= F.col("__w_rows"), F.col(f"__w_v_{name}")).otherwise(
                F.get(F.col(f"__w_t_{name}"), (F.col("__w_n") + n - F.col("__w_rows") - 1).cast("int"))["v"]
            )
        else:
            i, how = list(sums).index(spec["column"]), sums[spec["column"]]
            none = F.lit(0).cast(how.sum_type)
            both = {k: F.coalesce(F.col(f"__w_s{i}_{k}").cast(how.sum_type), none) + F.coalesce(F.col(f"__w_bs{i}_{k}").cast(how.sum_type), none) for k in how.parts(F.lit(0.0))}
            seen = F.col(f"__w_c{i}") + F.col(f"__w_bc{i}")
            value = how.total(both) if function == "running_sum" else F.when(seen > 0, how.total(both) / seen)
        out.append(value.alias(name))
    return joined.select(*out)


def _carry(
    placed: DataFrame, keys: list[str], order: list[str], tie: list[str], sums: Mapping[str, Whole | Doubles], shifts: Mapping[str, Mapping[str, Any]], with_rank: bool
) -> DataFrame:
    """One row per group and segment with what the group's other segments contribute."""
    inner = [*map(quoted, keys), SEGMENT]
    aggregates = [F.count(F.lit(1)).alias("__w_rows")]
    for i, (c, how) in enumerate(sums.items()):
        aggregates += [F.sum(v).alias(f"__w_ps{i}_{k}") for k, v in how.parts(number(placed, c)).items()]
        aggregates.append(F.count(number(placed, c)).alias(f"__w_pc{i}"))
    summary = placed.groupBy(*inner).agg(*aggregates)

    by_segment = Window.partitionBy(*map(quoted, keys)).orderBy(SEGMENT)
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    carried: dict[str, Column] = {"__w_before": F.coalesce(F.sum("__w_rows").over(earlier), F.lit(0))}
    for i, how in enumerate(sums.values()):
        carried |= {f"__w_bs{i}_{k}": F.sum(f"__w_ps{i}_{k}").over(earlier) for k in how.parts(F.lit(0.0))}
        carried[f"__w_bc{i}"] = F.coalesce(F.sum(f"__w_pc{i}").over(earlier), F.lit(0))

    if with_rank:
        per_value = placed.groupBy(*inner, *map(quoted, order)).agg(F.count(F.lit(1)).alias("__w_k"))
        ordered = F.struct(*map(quoted, order))
        ends = per_value.groupBy(*inner).agg(
            F.min(ordered).alias("__w_first"), F.max(ordered).alias("__w_last"), F.max_by("__w_k", ordered).alias("__w_at_last")
        )
        summary = _join_inner(summary, ends, [*keys, SEGMENT])
        run = Window.partitionBy(*map(quoted, keys), "__w_last").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summary = summary.withColumn("__w_run", F.sum("__w_at_last").over(run))
        same = F.lag("__w_last").over(by_segment).eqNullSafe(F.col("__w_first"))
        carried["__w_tied"] = F.when(same, F.lag("__w_run").over(by_segment)).otherwise(0)

    for name, spec in shifts.items():
        n, lag = int(spec.get("window", 1)), spec["function"] == "lag"
        sides = [named(c).desc_nulls_last() if lag else named(c).asc_nulls_first() for c in [*order, *tie]]
        sides.append(F.col(SERIAL).desc() if lag else F.col(SERIAL).asc())
        edge = (
            placed.withColumn("__w_e", F.row_number().over(Window.partitionBy(*inner).orderBy(*sides)))
            .where(F.col("__w_e") <= n)
            .groupBy(*inner)
            .agg(F.sort_array(F.collect_list(F.struct((F.col("__w_e") * (-1 if lag else 1)).alias("e"), named(spec["column"]).alias("v")))).alias(f"__w_e_{name}"))
        )
        summary = _join_inner(summary, edge, [*keys, SEGMENT])
        near = by_segment.rowsBetween(-n, -1) if lag else by_segment.rowsBetween(1, n)
        joined = F.flatten(F.collect_list(f"__w_e_{name}").over(near))
        carried[f"__w_t_{name}"] = joined
    return summary.withColumns(carried)


def _join_inner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join two summaries on null-safe keys, keeping the left keys once."""
    a, b = left.alias("a"), right.alias("b")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"a.{quoted(k)}").eqNullSafe(F.col(f"b.{quoted(k)}"))
    extra = [F.col(f"b.{quoted(c)}") for c in right.columns if c not in keys]
    return a.join(b, condition, "left").select(*[F.col(f"a.{quoted(c)}") for c in left.columns], *extra)
