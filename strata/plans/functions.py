"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import casts, dates, domain, strings
from strata.operators.transforms import in_batches
from strata.plans.registry import query
from strata.tables import load, view, with_views

NTZ = "timestamp_ntz"


@query("text_functions", r"""
    SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped,
           CASE WHEN source IN ('', 'NULL', 'null', 'None', 'N/A', 'n/a', 'NA') THEN NULL ELSE source END AS source_or_null,
           regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS cleaned,
           CASE WHEN contains(text, '@') THEN lower(split_part(text, '@', -1)) ELSE '' END AS email_domain,
           CASE WHEN length(source) > 4 THEN repeat('*', CAST(length(source) - 4 AS INTEGER)) || right(source, 4) ELSE repeat('*', CAST(length(source) AS INTEGER)) END AS masked,
           replace(lower(source), ' ', '_') AS slug, coalesce(nullif(lang, 'en'), 'other') AS lang_or_other
    FROM documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select(
        "doc_id", strings.strip("text").alias("stripped"), strings.null_if_token("source").alias("source_or_null"),
        strings.clean_string("text").alias("cleaned"), strings.email_domain("text").alias("email_domain"),
        strings.mask_keep_last("source").alias("masked"), strings.merchant_slug("source").alias("slug"),
        F.coalesce(F.nullif(F.col("lang"), F.lit("en")), F.lit("other")).alias("lang_or_other"),
    )


@query("title_case", r"""
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '(?s)\p{L}+|[^\p{L}]+'),
                                             lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), '') AS title
    FROM documents""")
def title_case(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", strings.title_case("text").alias("title"))


@query("surrogate_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, left(md5(concat(l_orderkey, '|', coalesce(nullif(l_returnflag, 'A'), 'None'), '|', l_linenumber)), 16) AS row_key,
           concat(coalesce(nullif(l_returnflag, 'A'), ''), '|', l_linestatus) AS natural_key
    FROM lineitem""")
def surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("A")))
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", strings.surrogate_hash("l_orderkey", "flag", "l_linenumber").alias("row_key"),
        strings.natural_key("flag", "l_linestatus").alias("natural_key"),
    )


@query("date_functions", """
    SELECT o_orderkey, CAST(date_trunc('year', d) AS DATE) AS year_start, CAST(date_trunc('quarter', d) AS DATE) AS quarter_start,
           CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(date_trunc('week', d) AS DATE) AS week_start,
           date_diff('day', d, DATE '1999-02-03') AS days, CAST(floor(date_diff('day', d, DATE '1999-02-03') / 7) AS BIGINT) AS weeks,
           CAST(floor(date_diff('day', d, DATE '1999-02-03') / 30) AS BIGINT) AS months, CAST(floor(date_diff('day', d, DATE '1999-02-03') / 365) AS BIGINT) AS years,
           year(DATE '2005-02-28') - year(d) - CASE WHEN 228 < month(d) * 100 + day(d) THEN 1 ELSE 0 END AS completed_years,
           CAST(CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS INTEGER) AS fiscal_year,
           CAST(floor(((month(d) + 5) % 12) / 3) + 1 AS INTEGER) AS fiscal_quarter
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    d, other = "o_orderdate", F.lit("1999-02-03").cast("date")
    return load(spark, sf, "orders").select(
        "o_orderkey", *[dates.date_trunc(d, u).alias(f"{u}_start") for u in dates.TRUNC_UNITS],
        *[dates.date_diff(d, other, u).alias(u) for u in dates.UNIT_DAYS],
        dates.completed_years(d, F.lit("2005-02-28").cast("date")).alias("completed_years"),
        dates.fiscal_year(d).alias("fiscal_year"), dates.fiscal_quarter(d).alias("fiscal_quarter"),
    )


@query("time_spans", """
    SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:30:00') - epoch_us(ts)) / 86400000000) AS BIGINT) AS stay_days,
           CAST(trunc((epoch_us(TIMESTAMP '2024-01-15 12:30:00') - epoch_us(ts)) / 60000000) AS BIGINT) AS minutes,
           (epoch_us(TIMESTAMP '2024-01-15 12:30:00') - epoch_us(ts)) / 3600000000 AS hours
    FROM events""")
def time_spans(spark: SparkSession, sf: str) -> DataFrame:
    end = F.lit("2024-01-15 12:30:00").cast(NTZ)
    return load(spark, sf, "events").select(
        "event_id", dates.whole_days_between("ts", end).alias("stay_days"), dates.whole_minutes_between("ts", end).alias("minutes"),
        dates.hours_between("ts", end).alias("hours"),
    )


@query("buckets", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' WHEN o_totalprice >= 300000 THEN 'High' WHEN o_totalprice >= 100000 THEN 'Medium' ELSE 'Low' END AS bucket,
           CASE WHEN o_totalprice > 300000 THEN 'HIGH' WHEN o_totalprice > 100000 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
           CASE WHEN s >= 95 THEN 'A+' WHEN s >= 90 THEN 'A' WHEN s >= 85 THEN 'B+' WHEN s >= 80 THEN 'B' WHEN s >= 75 THEN 'C+' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT *, o_totalprice / 5000 AS s FROM orders)""")
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return load(spark, sf, "orders").select(
        "o_orderkey", domain.categorize(price, [(0, "Low"), (100000, "Medium"), (300000, "High")]).alias("bucket"),
        domain.above("o_totalprice", [(300000, "HIGH"), (100000, "MEDIUM")], "LOW").alias("risk"),
        domain.letter_grade(F.col("o_totalprice") / 5000).alias("grade"),
    )


@query("domain_rules", """
    SELECT l_orderkey, l_linenumber, l_quantity,
           CASE WHEN l_quantity < 10 THEN CASE WHEN l_quantity < 8 THEN 'LL' ELSE 'L' END WHEN l_quantity > 40 THEN CASE WHEN l_quantity > 48 THEN 'HH' ELSE 'H' END END AS flag,
           l_quantity < 8 OR l_quantity > 48 AS critical, l_quantity < 5 OR l_quantity > 60 AS stream_critical,
           l_quantity < 10 OR l_quantity > 40 AS abnormal, greatest(0, 30 - l_quantity) AS seats,
           CASE WHEN l_extendedprice > 0 THEN round(l_quantity / l_extendedprice * 100, 6) END AS burn_rate
    FROM lineitem""")
def domain_rules(spark: SparkSession, sf: str) -> DataFrame:
    low, high, q = F.lit(10.0), F.lit(40.0), "l_quantity"
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", q, domain.range_flag(q, low, high).alias("flag"), domain.range_critical(q, low, high).alias("critical"),
        domain.stream_range_critical(q, low, high).alias("stream_critical"), domain.outside_range(q, low, high).alias("abnormal"),
        domain.available_seats(F.lit(30), q).alias("seats"), F.round(domain.burn_rate(q, "l_extendedprice"), 6).alias("burn_rate"),
    )


@query("json_fields", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing,
           CASE WHEN event_type = 'click' THEN 'click,view' ELSE event_type END AS tags
    FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.when(F.col("event_type") == "click", F.lit('["click", "view"]')).otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    return load(spark, sf, "events").select(
        "event_id", strings.json_text("props", "$.k").alias("k"), strings.json_text("props", "$.missing").alias("missing"),
        F.array_join(strings.json_array(tags), ",").alias("tags"),
    )


@query("safe_casts", with_views("patients") + """
    SELECT patient_id, CAST(trunc(TRY_CAST(last_name || '.75' AS DOUBLE)) AS BIGINT) AS as_int, coalesce(TRY_CAST(first_name AS DOUBLE), -1) AS as_float,
           CASE WHEN patient_id % 2 = 0 THEN true ELSE false END AS as_bool, CAST(date_of_birth AS DATE) AS as_date, CAST(NULL AS DATE) AS bad_date
    FROM patients""")
def safe_casts(spark: SparkSession, sf: str) -> DataFrame:
    people = view(spark, sf, "patients")
    text_bool = F.when(F.col("patient_id") % 2 == 0, "Yes").otherwise("no")
    return people.select(
        "patient_id", casts.safe_cast(F.concat("last_name", F.lit(".75")), "int").alias("as_int"), casts.safe_cast("first_name", "float", -1.0).alias("as_float"),
        casts.safe_cast(text_bool, "boolean").alias("as_bool"), casts.safe_cast(F.col("date_of_birth").cast("string"), "date").alias("as_date"),
        casts.safe_cast("first_name", "date").alias("bad_date"),
    )


@query("batch_function", "SELECT event_id, user_id, round(value * 2, 2) AS doubled FROM events")
def batch_function(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    return in_batches(events, lambda b: b.assign(doubled=(b["value"] * 2).round(2))[["event_id", "user_id", "doubled"]], "event_id long, user_id long, doubled double")
