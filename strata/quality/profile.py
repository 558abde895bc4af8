"""Column and dataset profiles, drift between profiles, and the quality score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions._cols import quoted
from strata.functions.domain import letter_grade
from strata.operators.dedup import compact_key, duplicate_summary, top_n_per_group
from strata.operators.quantiles import exact_median
from strata.operators.windows import HOT_ROWS
from strata.session import scratch_path

# What a text that looks like a date starts with, and the weights of the score.
DATE_LIKE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})"
WEIGHTS = {"completeness": 0.3, "uniqueness": 0.2, "validity": 0.3, "consistency": 0.2}
NULL_RATE_CHANGE = 0.05

#: Characters by which frequent values are told apart without a digest; digests of long ones that are broadcast.
HEAD, FETCHED = 64, 200_000


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows, those whose SHA-256 of ``seed:key`` is least (the key's parts as text, joined by ``|``, null as '').

    The same rows whatever the partitioning; every task keeps ``n`` of its own, and samples of parts merge into that
    of the whole. Without a key the whole row counts, in text form. Rows of one key are told apart by the whole row.
    """
    whole = F.to_json(F.struct(*[F.col(quoted(c)) for c in df.columns]), {"ignoreNullFields": "false"})
    parts = F.concat_ws("|", *[F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")) for k in key]) if key else whole
    return df.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), parts), 256), whole).limit(n)


def _label(kind: T.DataType) -> str:
    for label, types in (
        ("bool", (T.BooleanType,)), ("int", (T.IntegralType,)), ("float", (T.NumericType,)), ("string", (T.StringType,)),
        ("date", (T.DateType, T.TimestampType, T.TimestampNTZType)), ("array", (T.ArrayType,)), ("object", (T.StructType, T.MapType)),
    ):
        if isinstance(kind, types):
            return label
    return "other"


def _text_values(df: DataFrame, columns: Sequence[str], digest: bool) -> DataFrame:
    """(column_name, value) rows of the columns in text form."""
    texts = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in columns])

    def text(name: str) -> Column:
        return compact_key(texts, name) if digest else F.col(quoted(name))

    return texts.select(*[text(c).alias(c) for c in columns]).unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "value")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, n) over the non-null values; counted before the shuffle."""
    rows = _text_values(df, columns or df.columns, digest=False).where(F.col("value").isNotNull())
    return rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """(column_name, value, n, position): most frequent values per column; equal counts are ordered by value.

    Values are counted by their first ``HEAD`` characters and, where they are longer, the digest of the whole text, so
    no long text crosses the shuffle. What comes after the n-th count and head of its column is out; that leaves n
    values a column and those that tie with the n-th in both. The long ones among these are fetched last: by a
    broadcast of their digests while these are ``FETCHED`` at most (some 20 MB), else by an ordinary join.
    """
    spark = df.sparkSession
    value = F.col("value")
    values = _text_values(df, columns or df.columns, digest=False).where(value.isNotNull())
    keyed = values.withColumns({"head": F.left(value, F.lit(HEAD)), "digest": F.when(F.length(value) > HEAD, F.sha2(value, 256)).otherwise("")})
    counts = keyed.groupBy("column_name", "head", "digest").agg(F.count(F.lit(1)).alias("n"))
    last = top_n_per_group(counts, ["column_name"], [F.desc("n"), F.asc("head")], n, "place").groupBy("column_name").agg(F.max(F.struct(-F.col("n"), "head")).alias("last"))
    path = scratch_path(spark, "top-values")
    counts.join(last, "column_name").where(F.struct(-F.col("n"), "head") <= F.col("last")).select("column_name", "head", "digest", "n").write.parquet(path)
    candidates = spark.read.schema(counts.schema).parquet(path)
    named = candidates.where("digest = ''").select("column_name", F.col("head").alias("value"), "n")
    long = candidates.where("digest <> ''").drop("head")
    fetched = long.count()
    if fetched:
        texts = keyed.where("digest <> ''").drop("head").join(F.broadcast(long) if fetched <= FETCHED else long, ["column_name", "digest"])
        named = named.unionByName(texts.groupBy("column_name", "digest").agg(F.first("value").alias("value"), F.first("n").alias("n")).drop("digest"))
    return top_n_per_group(named, ["column_name"], [F.desc("n"), F.asc("value")], n, "position")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column_name, unique_count): exact by default; approximate needs no shuffle of the values."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(F.col(quoted(c)).cast("string")).alias(c) for c in columns])
        return wide.unpivot([], [F.col(quoted(c)) for c in columns], "column_name", "unique_count")
    rows = _text_values(df, columns, digest=True).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.lit(1).alias("one"))
    return rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False, medians: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per column: type, counts, rates, numeric statistics and text lengths.

    All plain statistics come from one aggregate over the table. A text column is called ``date``
    when most of its values look like dates. ``medians=False`` saves their pass over the values.
    """
    names = list(columns or df.columns)
    kinds = {c: _label(df.schema[c].dataType) for c in names}
    numeric = [c for c in names if kinds[c] in ("int", "float")]
    texts = [c for c in names if kinds[c] == "string"]

    # Written as SQL text: one expression per column instead of one driver call per function.
    totals, rows = ["count(1) AS total"], []
    for i, c in enumerate(names):
        q, numbers, lengths = quoted(c), "NULL", "NULL"
        label = f"'{kinds[c]}'"
        totals.append(f"count({q}) AS n{i}")
        if c in numeric:
            v = f"CAST({q} AS DOUBLE)"
            exact = v if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else q
            totals.append(f"struct(min({v}) AS lo, max({v}) AS hi, avg({v}) AS mean, stddev_samp({v}) AS std, CAST(sum({exact}) AS DOUBLE) AS sum) AS s{i}")
            numbers = f"s{i}"
        elif c in texts:
            totals.append(f"struct(min(char_length({q})) AS lo, max(char_length({q})) AS hi, avg(char_length({q})) AS mean, count_if({q} RLIKE r'{DATE_LIKE}') AS dates) AS t{i}")
            label = f"CASE WHEN t{i}.dates * 2 > n{i} THEN 'date' ELSE 'string' END"
            lengths = f"CASE WHEN NOT t{i}.dates * 2 > n{i} THEN t{i} END"

        def part(struct: str, field_name: str, kind: str) -> str:
            return f"CAST({'NULL' if struct == 'NULL' else f'({struct}).{field_name}'} AS {kind})"

        rows.append(
            f"struct({_literal(c)} AS column_name, CASE WHEN n{i} = 0 THEN 'null' ELSE {label} END AS data_type, total AS total_count, total - n{i} AS null_count, "
            + ", ".join(f"{part(numbers, k, 'DOUBLE')} AS {n}" for k, n in (("lo", "min_value"), ("hi", "max_value"), ("mean", "mean_value"), ("std", "std_dev"), ("sum", "sum_value")))
            + ", " + ", ".join(f"{part(lengths, k, t)} AS {n}" for k, n, t in (("lo", "min_length", "BIGINT"), ("hi", "max_length", "BIGINT"), ("mean", "avg_length", "DOUBLE")))
            + ")"
        )
    tall = df.agg(*[F.expr(t) for t in totals]).select(F.expr(f"inline(array({', '.join(rows)}))"))
    tall = tall.join(distinct_counts(df, names, approximate), "column_name", "left")
    if numeric and medians:
        values = df.select(*[F.col(quoted(c)).cast("double").alias(c) for c in numeric]).unpivot([], [F.col(quoted(c)) for c in numeric], "column_name", "value")
        tall = tall.join(exact_median(values, ["column_name"], "value", "median_value", hot_rows, few_groups=True), "column_name", "left")
    else:
        tall = tall.withColumn("median_value", F.lit(None).cast("double"))
    present = F.col("total_count") - F.col("null_count")
    null_rate = F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count")).otherwise(0.0)
    return tall.withColumns({
        "unique_count": F.coalesce("unique_count", F.lit(0)),
        "median_value": F.when(present > 1, F.col("median_value")),
        "null_rate": F.round(null_rate, 4),
        "completeness": F.round(1 - null_rate, 4),
        "uniqueness_rate": F.when(present > 0, F.round(F.coalesce("unique_count", F.lit(0)) / present, 4)).otherwise(0.0),
        "mean_value": F.round("mean_value", 4),
        "std_dev": F.round("std_dev", 4),
        "avg_length": F.round("avg_length", 2),
    }).select(
        "column_name", "data_type", "total_count", "null_count", "null_rate", "unique_count", "uniqueness_rate", "completeness",
        "min_value", "max_value", "mean_value", "median_value", "std_dev", "sum_value", "min_length", "max_length", "avg_length",
    )


def profile_dataset(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, columns, surplus copies of rows, and mean completeness of the columns."""
    filled = " + ".join(f"count({quoted(c)})" for c in df.columns)
    complete = df.agg(F.expr(f"CASE WHEN count(1) > 0 THEN round(({filled}) / (count(1) * {len(df.columns)}D), 4) ELSE 0D END AS overall_completeness"))
    copies = duplicate_summary(df)
    one = F.lit(1).alias("__one")
    joined = copies.select("*", one).join(complete.select("*", one), "__one").drop("__one")
    return joined.select(
        F.lit(name).alias("name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.col("duplicate_rows").alias("duplicate_row_count"),
        F.when(F.col("row_count") > 0, F.round(F.col("duplicate_rows") / F.col("row_count"), 4)).otherwise(0.0).alias("duplicate_rate"),
        "overall_completeness",
    )


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two column profiles: columns added, removed or modified, with the old and new figures."""
    def side(profile: DataFrame, suffix: str) -> DataFrame:
        return profile.select("column_name", *[F.col(c).alias(f"{c}_{suffix}") for c in ("null_rate", "data_type", "unique_count")])

    both = side(before, "before").join(side(after, "after"), "column_name", "full_outer")
    flags = both.withColumns({
        "null_rate_changed": F.coalesce(F.abs(F.col("null_rate_before") - F.col("null_rate_after")) > NULL_RATE_CHANGE, F.lit(False)),
        "data_type_changed": F.coalesce(F.col("data_type_before") != F.col("data_type_after"), F.lit(False)),
        "unique_count_changed": F.coalesce(F.col("unique_count_before") != F.col("unique_count_after"), F.lit(False)),
    })
    change = (
        F.when(F.col("data_type_before").isNull(), "added").when(F.col("data_type_after").isNull(), "removed")
        .when(F.col("null_rate_changed") | F.col("data_type_changed") | F.col("unique_count_changed"), "modified")
    )
    return flags.withColumn("change", change).where(F.col("change").isNotNull())


def dataset_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row-count and completeness change between two dataset profiles of one row each."""
    a, b = before.withColumn("__one", F.lit(1)).alias("a"), after.withColumn("__one", F.lit(1)).alias("b")
    rows_a, rows_b = F.col("a.row_count"), F.col("b.row_count")
    return a.join(b, F.col("a.__one") == F.col("b.__one")).select(
        F.col("a.name").alias("before_name"), F.col("b.name").alias("after_name"),
        (rows_b - rows_a).alias("row_count_diff"),
        F.when(rows_a > 0, F.round((rows_b - rows_a) / rows_a * 100, 4)).otherwise(0.0).alias("row_count_change_pct"),
        F.round(F.col("b.overall_completeness") - F.col("a.overall_completeness"), 4).alias("completeness_diff"),
    )


def quality_score(columns: DataFrame, dataset: DataFrame, key_column: str, validation: DataFrame | None = None, name: str = "dataset") -> DataFrame:
    """Weighted score from 0 to 100 with its four parts and a grade; all inputs are small summaries."""
    share = F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count")).otherwise(0.0)
    unique = F.when(F.col("total_count") > F.col("null_count"), F.col("unique_count") / (F.col("total_count") - F.col("null_count"))).otherwise(0.0)
    parts = columns.agg(
        F.coalesce(F.avg(1 - share) * 100, F.lit(0.0)).alias("completeness"),
        F.coalesce(F.max(F.when(F.col("column_name") == key_column, unique)) * 100, F.lit(0.0)).alias("uniqueness"),
        F.lit(1).alias("__one"),
    )
    rows = dataset.select(
        "row_count", F.when(F.col("row_count") > 0, (1 - F.col("duplicate_row_count") / F.col("row_count")) * 100).otherwise(100.0).alias("consistency"),
        F.lit(1).alias("__one"),
    )
    joined = parts.join(rows, "__one")
    if validation is None:
        joined = joined.withColumn("validity", F.lit(100.0))
    else:
        valid = F.when(F.col("total_records") > 0, F.col("valid_records") / F.col("total_records") * 100).otherwise(0.0)
        joined = joined.join(validation.select(valid.alias("validity"), F.lit(1).alias("__one")), "__one")
    overall = sum((F.col(part) * weight for part, weight in list(WEIGHTS.items())[1:]), F.col("completeness") * WEIGHTS["completeness"])
    return joined.select(
        F.lit(name).alias("name"), F.col("row_count"), F.round(overall, 2).alias("overall_score"),
        *[F.round(part, 2).alias(part) for part in WEIGHTS], letter_grade(overall).alias("grade"),
    )
