"""Column profiles as mergeable state: each load is read once, and profiles of any set of loads come from their states.

A state has a row per column: counts, sums and extremes, a HyperLogLog sketch of the different values and, for
numbers, a KLL sketch of their order. One aggregate over the load makes it, no value is shuffled, and states of
parts merge into that of the whole. Counts, extremes, lengths and sums are exact (sums of doubles as doubles add
up), the number of different values and the median are estimates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import quoted
from strata.quality.profile import DATE_LIKE, _label
from strata.sources.incremental import exists

#: Size of the sketches: standard error of distinct values about 1.04 / 2^6.5 (1.2 %), of a rank about 0.8 % at 400.
DISTINCT_BITS, ORDER = 13, 400

STATE = (
    "column_name string, kind string, total bigint, present bigint, dates bigint, lo double, hi double, sum double, mean double, squares double, "
    "min_length bigint, max_length bigint, length_sum bigint, values binary, ranks binary"
)


def state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The state of a load, one row per column; an empty load has counts of 0 and no sketches' values."""
    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    aggregates, rows = [F.count(F.lit(1)).alias("total")], []
    for i, name in enumerate(columns or df.columns):
        c, kind = F.col(quoted(name)), _label(df.schema[name].dataType)
        aggregates += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(c.cast("string"), DISTINCT_BITS).alias(f"v{i}")]
        numbers, lengths, ranks, dates = [none("double")] * 5, [none("bigint")] * 3, none("binary"), F.lit(0).cast("bigint")
        if kind in ("int", "float"):
            v = c.cast("double")
            exact = v if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else c
            parts = (F.min(v), F.max(v), F.sum(exact).cast("double"), F.avg(v), F.var_pop(v) * F.count(v))
            aggregates += [F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).alias(f"s{i}"), F.kll_sketch_agg_double(v, ORDER).alias(f"r{i}")]
            numbers, ranks = [F.col(f"s{i}.p{k}") for k in range(5)], F.col(f"r{i}")
        elif kind == "string":
            size = F.char_length(c).cast("bigint")
            parts = (F.min(size), F.max(size), F.sum(size), F.count_if(c.rlike(DATE_LIKE)))
            aggregates.append(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]).alias(f"s{i}"))
            *lengths, dates = [F.col(f"s{i}.p{k}") for k in range(4)]
        fields = [F.lit(name), F.lit(kind), F.col("total"), F.col(f"n{i}"), dates, *numbers, *lengths, F.col(f"v{i}"), ranks]
        names = [field.split()[0] for field in STATE.split(", ")]
        rows.append(F.struct(*[f.alias(n) for f, n in zip(fields, names)]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merge(states: DataFrame) -> DataFrame:
    """One state from states of parts, by column name. A column of several kinds gets the kind ``mixed``."""
    means = states.groupBy("column_name").agg((F.sum(F.col("mean") * F.col("present")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("present")))).alias("__mean"))
    # deviations from the mean of all: those from the own mean of each part, and its distance from the common one
    moved = F.col("squares") + F.col("present") * F.pow(F.col("mean") - F.col("__mean"), 2)
    kinds = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed")
    return states.join(means, "column_name").groupBy("column_name").agg(
        kinds.alias("kind"), *[F.sum(c).alias(c) for c in ("total", "present", "dates")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sum").alias("sum"),
        F.max("__mean").alias("mean"), F.sum(moved).alias("squares"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.sum("length_sum").alias("length_sum"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks", ORDER).alias("ranks"),
    )


def profile(states: DataFrame) -> DataFrame:
    """The profile of all loads behind ``states``, with the columns of ``profile_columns``; ``drift`` takes it as well."""
    s = merge(states)
    total, present = F.col("total"), F.col("present")
    is_date = (F.col("kind") == "string") & (F.col("dates") * 2 > present)
    number = F.col("kind").isin("int", "float")
    null_rate = F.when(total > 0, (total - present) / total).otherwise(0.0)
    unique = F.least(F.hll_sketch_estimate("values"), present)
    length = lambda c: F.when((F.col("kind") == "string") & ~is_date, c)
    # the nested test keeps the sketch function from an empty sketch, which it refuses
    median = F.when(number & (present > 1), F.kll_sketch_get_quantile_double(F.when(number & (present > 1), F.col("ranks")), F.lit(0.5)))
    return s.select(
        "column_name", F.when(present == 0, "null").when(is_date, "date").otherwise(F.col("kind")).alias("data_type"), total.alias("total_count"), (total - present).alias("null_count"),
        F.round(null_rate, 4).alias("null_rate"), unique.alias("unique_count"), F.when(present > 0, F.round(unique / present, 4)).otherwise(0.0).alias("uniqueness_rate"),
        F.round(1 - null_rate, 4).alias("completeness"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"), F.round("mean", 4).alias("mean_value"), median.alias("median_value"),
        F.when(present > 1, F.round(F.sqrt(F.col("squares") / (present - 1)), 4)).alias("std_dev"), F.col("sum").alias("sum_value"),
        length(F.col("min_length")).alias("min_length"), length(F.col("max_length")).alias("max_length"), length(F.round(F.col("length_sum") / present, 2)).alias("avg_length"),
    )


def save(states: DataFrame, store: str, load: str) -> None:
    """Keep the state of a load under its name; a load that is repeated replaces its own state only."""
    states.coalesce(1).write.mode("overwrite").parquet(f"{store.rstrip('/')}/load={load}")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """All states of a store with the name of their ``load``; none if nothing has been kept."""
    schema = f"{STATE}, load string"
    return spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)


def trend(states: DataFrame) -> DataFrame:
    """Profile figures by load, for comparisons over time without a look at the data: ``load, column_name, total_count, null_rate, unique_count, mean_value``."""
    rate = F.when(F.col("total") > 0, F.round((F.col("total") - F.col("present")) / F.col("total"), 4)).otherwise(0.0)
    unique = F.least(F.hll_sketch_estimate("values"), F.col("present"))
    return states.select("load", "column_name", F.col("total").alias("total_count"), rate.alias("null_rate"), unique.alias("unique_count"), F.round("mean", 4).alias("mean_value"))
