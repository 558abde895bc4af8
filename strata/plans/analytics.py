"""Grouping, pivoting, windows, ranking, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import aggregate as agg
from strata.operators import dedup, exact_sum, pivot, quantiles, windows
from strata.plans.registry import ORACLES, query
from strata.quality import profile
from strata.tables import load, view, with_views


@query("aggregate", """
    SELECT nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, round(avg(l_quantity), 4) AS avg_qty,
           count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, min(l_shipdate) AS first_ship, max(l_quantity) AS max_qty,
           round(stddev_samp(l_quantity), 4) AS std_qty
    FROM lineitem GROUP BY ALL""")
def aggregate(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").withColumns({
        "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("A")), "price": F.col("l_extendedprice").cast("decimal(18,2)"),
    })
    result = agg.aggregate(items, ["l_returnflag", "l_linestatus"], {
        "sum_price": {"column": "price", "function": "sum"}, "avg_qty": {"column": "l_quantity", "function": "avg"}, "n": {"function": "count"},
        "suppliers": {"column": "l_suppkey", "function": "count_distinct"}, "first_ship": {"column": "l_shipdate", "function": "min"},
        "max_qty": {"column": "l_quantity", "function": "max"}, "std_qty": {"column": "l_quantity", "function": "std"},
    })
    return result.withColumns({"avg_qty": F.round("avg_qty", 4), "std_qty": F.round("std_qty", 4)})


@query("aggregate_filters_having", """
    SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, max(o_totalprice) AS largest
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' AND o_totalprice > 50000
    GROUP BY o_custkey HAVING count(*) >= 2 AND max(o_totalprice) < 450000""")
def aggregate_filters_having(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    return agg.aggregate(
        orders, ["o_custkey"],
        {"n": {"function": "count"}, "spent": {"column": "price", "function": "sum"}, "largest": {"column": "o_totalprice", "function": "max"}},
        filters={"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": "O", "o_totalprice": lambda c: c > 50000},
        having={"n": {"operator": "gte", "value": 2}, "largest": {"operator": "lt", "value": 450000}},
    )


@query("aggregate_first_last", """
    SELECT o_orderpriority, first(status ORDER BY o_orderdate, o_orderkey) FILTER (status IS NOT NULL) AS first_status,
           last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS last_price
    FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders) GROUP BY o_orderpriority""")
def aggregate_first_last(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return agg.aggregate(orders, ["o_orderpriority"], {
        "first_status": {"column": "status", "function": "first"}, "last_price": {"column": "o_totalprice", "function": "last"},
    }, order_by=["o_orderdate", "o_orderkey"])


@query("aggregate_transformer", """
    SELECT p_brand, CAST(coalesce(sum(size), 0) AS DOUBLE) AS sum_size, coalesce(round(avg(size), 6), 0) AS avg_size, count(size) AS n_size,
           min(p_retailprice) AS min_price, max(p_retailprice) AS max_price
    FROM (SELECT *, CASE WHEN p_size > 10 THEN p_size END AS size FROM part) GROUP BY p_brand""")
def aggregate_transformer(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part").withColumn("size", F.when(F.col("p_size") > 10, F.col("p_size")))
    result = agg.aggregate_step(part, ["p_brand"], {
        "sum_size": {"column": "size", "function": "sum"}, "avg_size": {"column": "size", "function": "avg"}, "n_size": {"column": "size", "function": "count"},
        "min_price": {"column": "p_retailprice", "function": "min"}, "max_price": {"column": "p_retailprice", "function": "max"},
    })
    return result.withColumn("avg_size", F.round("avg_size", 6))


@query("pivot_prefixed", """
    SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN price END), 0) AS DOUBLE) AS o_orderstatus_F,
           CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN price END), 0) AS DOUBLE) AS o_orderstatus_O
    FROM (SELECT o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)
    WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey""")
def pivot_prefixed(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(
        "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return pivot.pivot(orders, ["o_custkey"], "o_orderstatus", "price", "sum")


@query("pivot_average", """
    SELECT l_shipyear, round(avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS l_returnflag_A,
           round(avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS l_returnflag_N,
           round(avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS l_returnflag_R
    FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipyear, l_returnflag, l_quantity FROM lineitem) GROUP BY l_shipyear""")
def pivot_average(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").select(F.year("l_shipdate").alias("l_shipyear"), "l_returnflag", "l_quantity")
    wide = pivot.pivot(items, ["l_shipyear"], "l_returnflag", "l_quantity", "avg", pivot_on=["A", "N", "R"])
    return wide.select("l_shipyear", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


@query("pivot_rows_macro", """
    SELECT o_orderpriority,
           coalesce(round(sum(CASE WHEN s = 'F' THEN v END) / nullif(count(CASE WHEN s = 'F' THEN 1 END), 0), 4), 0) AS s_F,
           coalesce(round(sum(CASE WHEN s = 'O' THEN v END) / nullif(count(CASE WHEN s = 'O' THEN 1 END), 0), 4), 0) AS s_O,
           coalesce(round(sum(CASE WHEN s IS NULL THEN v END) / nullif(count(CASE WHEN s IS NULL THEN 1 END), 0), 4), 0) AS "s_None"
    FROM (SELECT o_orderpriority, nullif(o_orderstatus, 'P') AS s, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS v FROM orders)
    GROUP BY o_orderpriority""")
def pivot_rows_macro(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").select(
        "o_orderpriority", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("s"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("v"))
    wide = pivot.pivot_rows(orders, "o_orderpriority", "s", "v", "avg")
    return wide.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in wide.columns[1:]])


@query("pivot_long", "SELECT o_orderpriority, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cell FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def pivot_long(spark: SparkSession, sf: str) -> DataFrame:
    """Cells by priority and customer, more customers than a table can have columns."""
    orders = load(spark, sf, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")).alias("price"))
    cells = pivot.pivot_long(orders, ["o_orderpriority"], "o_custkey", "price")
    return cells.withColumn("cell", F.col("cell").cast("double"))


@query("unpivot_columns", """
    SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', nullif(l_discount, 0) FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot_columns(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return pivot.unpivot_columns(items, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("window_rank_lag_lead", """
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY status ORDER BY o_orderdate) AS rk,
           lag(o_totalprice, 2) OVER w AS before_price, lead(o_orderpriority) OVER w AS next_priority
    FROM (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)
    WINDOW w AS (PARTITION BY status ORDER BY o_orderdate, o_orderkey)""")
def window_rank_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return windows.window(orders, ["status"], "o_orderdate", {
        "rn": {"function": "row_number"}, "rk": {"function": "rank"},
        "before_price": {"function": "lag", "column": "o_totalprice", "window": 2}, "next_priority": {"function": "lead", "column": "o_orderpriority"},
    }, tie_break=["o_orderkey"]).select("o_orderkey", "rn", "rk", "before_price", "next_priority")


@query("window_running", """
    SELECT o_orderkey, CAST(coalesce(sum(price) OVER w, 0) AS DOUBLE) AS running_sum, CAST(sum(price) OVER w AS DOUBLE) / nullif(count(price) OVER w, 0) AS running_avg
    FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS price FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def window_running(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")))
    result = windows.window(orders, ["o_custkey"], "o_orderdate", {
        "running_sum": {"function": "running_sum", "column": "price"}, "running_avg": {"function": "running_avg", "column": "price"},
    }, tie_break=["o_orderkey"])
    return result.select("o_orderkey", "running_sum", "running_avg")


@query("window_running_split", ORACLES["window_running"].replace("PARTITION BY o_custkey", "PARTITION BY o_orderpriority"))
def window_running_split(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums and means over groups that are split into many segments: the same as over whole ones."""
    orders = load(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)")))
    return windows.window(orders, ["o_orderpriority"], "o_orderdate", {
        "running_sum": {"function": "running_sum", "column": "price"}, "running_avg": {"function": "running_avg", "column": "price"},
    }, tie_break=["o_orderkey"], hot_rows=100).select("o_orderkey", "running_sum", "running_avg")


# A scale for each type of event, from far below to far above one; some of the largest are infinite.
_SCALED = """CASE event_type WHEN 'view' THEN floor(value) * power(2, -900) WHEN 'click' THEN floor(value) * power(2, -50) WHEN 'error' THEN floor(value) * power(2, 100)
    WHEN 'signup' THEN CASE WHEN event_id % 97 = 5 THEN CAST('Infinity' AS DOUBLE) ELSE floor(value) END ELSE floor(value) * power(2, 900) END"""


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "event_type", "user_id", F.expr(_SCALED).alias("scaled.value"))


@query("window_running_scales", f"""
    SELECT event_id, sum(scaled) OVER w AS running_sum, sum(scaled) OVER w / count(scaled) OVER w AS running_avg FROM (SELECT *, {_SCALED} AS scaled FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING)""")
def window_running_scales(spark: SparkSession, sf: str, hot_rows: int = windows.HOT_ROWS) -> DataFrame:
    """Running sums of doubles of any size, none of them rounded away."""
    return windows.window(_scaled(spark, sf), ["event_type"], "user_id", {
        "running_sum": {"function": "running_sum", "column": "scaled.value"}, "running_avg": {"function": "running_avg", "column": "scaled.value"},
    }, tie_break=["event_id"], hot_rows=hot_rows).select("event_id", "running_sum", "running_avg")


@query("window_running_scales_split", ORACLES["window_running_scales"])
def window_running_scales_split(spark: SparkSession, sf: str) -> DataFrame:
    return window_running_scales(spark, sf, hot_rows=300)


@query("exact_totals", f"""
    SELECT event_type, user_id % 10 AS part, sum(scaled) AS total, count(scaled) AS total_n FROM (SELECT *, {_SCALED} AS scaled FROM events) GROUP BY ALL""")
def exact_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scaled(spark, sf).withColumn("part", F.col("user_id") % 10)
    return exact_sum.exact_sums(rows, ["event_type", "part"], {"total": "scaled.value"}, "_n")


@query("window_split_group", """
    SELECT event_id, row_number() OVER w AS rn, rank() OVER (PARTITION BY event_type ORDER BY user_id) AS rk, lag(value, 3) OVER w AS before_value
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id, ts, event_id)""")
def window_split_group(spark: SparkSession, sf: str) -> DataFrame:
    """The path for groups too large for one task, taken here by a low limit."""
    events = load(spark, sf, "events")
    return windows.window(events, ["event_type"], "user_id", {
        "rn": {"function": "row_number"}, "rk": {"function": "rank"}, "before_value": {"function": "lag", "column": "value", "window": 3},
    }, tie_break=["ts", "event_id"], hot_rows=1500).select("event_id", "rn", "rk", "before_value")


@query("weighted_mean", with_views("enrollments") + """
    SELECT student_id, round(sum(grade_points * credits) / greatest(1, sum(credits)), 6) AS gpa FROM enrollments GROUP BY student_id""")
def weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "enrollments")
    return rows.groupBy("student_id").agg(F.round(agg.weighted_mean(F.col("grade_points"), F.col("credits")), 6).alias("gpa"))


@query("rates", with_views("enrollments", "courses") + """
    SELECT c.term, round(count(CASE WHEN e.grade = 'A' THEN 1 END) / count(*), 4) AS a_rate,
           round(avg(CASE WHEN coalesce(c.capacity, 1) > 0 THEN c.enrolled_count / coalesce(c.capacity, 1) END), 4) AS fill_rate,
           round(coalesce(stddev_samp(e.grade_points), 0), 4) AS points_std
    FROM enrollments e JOIN courses c ON e.course_id = c.course_id GROUP BY c.term""")
def rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "enrollments").join(view(spark, sf, "courses"), "course_id")
    return rows.groupBy("term").agg(
        agg.share(F.col("grade") == "A").alias("a_rate"), F.round(agg.mean_ratio(F.col("enrolled_count"), F.col("capacity")), 4).alias("fill_rate"),
        F.round(agg.std_or_zero(F.col("grade_points")), 4).alias("points_std"),
    )


@query("value_distribution", "SELECT nullif(lang, 'de') AS value, count(*) AS n FROM documents GROUP BY 1")
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return agg.distribution(load(spark, sf, "documents").withColumn("lang", F.nullif(F.col("lang"), F.lit("de"))), "lang")


@query("exact_median", """
    SELECT event_type, median(value) AS median_value FROM events GROUP BY event_type""")
def exact_median(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.exact_median(load(spark, sf, "events"), ["event_type"], "value", "median_value")


@query("topk_texts", """
    SELECT column_name, value, n, CAST(position AS INTEGER) AS position FROM (
      SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position FROM (
        SELECT 'text' AS column_name, text AS value, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text
        UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source) AS c) AS r
    WHERE position <= 10""")
def topk_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent whole texts; heads and digests are counted, ten texts are fetched."""
    return profile.top_values(load(spark, sf, "documents"), ["text", "source"])


@query("topk_values", """
    SELECT column_name, value, n, position FROM (
      SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS position FROM (
        SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand
        UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type
        UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY p_size)) WHERE position <= 10""")
def topk_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_values(load(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("ordered_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey")
def ordered_scan(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey")


_LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_LINE_DESC = ", ".join(f"{c.strip()} DESC" for c in _LINE_ORDER.split(","))


@query("dedup_first", f"""
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("dedup_last", f"""
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_DESC}) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"], keep="last")


@query("dedup_texts", """
    SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_texts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate(load(spark, sf, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("duplicate_rows", """
    SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) AS n FROM (SELECT * FROM events UNION ALL SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 MICROSECOND ELSE ts END AS ts) FROM events) GROUP BY event_id, ts, user_id, event_type, value, props)""")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their copies, every third of which is a microsecond later and so another row."""
    events = load(spark, sf, "events")
    moved = events.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 0.000001 SECOND")).otherwise(F.col("ts")))
    return dedup.duplicate_summary(events.unionByName(moved))


@query("derived_dimension", with_views("transactions") + """
    SELECT merchant_name, merchant_category, transaction_type FROM (
      SELECT *, row_number() OVER (PARTITION BY merchant_name ORDER BY transaction_id) AS rn FROM transactions WHERE merchant_name IS NOT NULL) WHERE rn = 1""")
def derived_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.derived_dimension(view(spark, sf, "transactions"), "merchant_name", ["merchant_category", "transaction_type"], ["transaction_id"])


@query("union_batches", """
    SELECT c_custkey AS party_key, c_name AS party_name, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def union_batches(spark: SparkSession, sf: str) -> DataFrame:
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"), F.col("c_mktsegment").alias("segment"))
    suppliers = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("pivot_column_names", "SELECT DISTINCT 'o_orderpriority_' || o_orderpriority AS column_name FROM orders ORDER BY 1")
def pivot_column_names(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct values that a pivot would turn into columns."""
    names = load(spark, sf, "orders").select(F.concat(F.lit("o_orderpriority_"), "o_orderpriority").alias("column_name"))
    return names.distinct().orderBy("column_name")


@query("report_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def report_preview(spark: SparkSession, sf: str) -> DataFrame:
    """First 20 rows of a report table."""
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
