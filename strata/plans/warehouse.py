"""Dimensions, slowly changing dimensions, upserts and star schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.dedup import deduplicate
from strata.plans.registry import query
from strata.session import scratch_path
from strata.tables import load, view, with_views
from strata.warehouse import bucketed, dims, scd, star

AS_OF = "2024-06-30"
CUTOFF = "1998-01-01"


def customer_state(spark: SparkSession, sf: str, before: str | None = None) -> DataFrame:
    """What the latest order of each customer tells about them, at a date or now."""
    orders = load(spark, sf, "orders")
    if before:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    rows = orders.select("o_custkey", F.col("o_orderpriority").alias("tier"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderdate", "o_orderkey")
    return deduplicate(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], keep="last").select("o_custkey", "tier", "status")


def _state_sql(before: str | None = None) -> str:
    where = f"WHERE o_orderdate < TIMESTAMP '{before}'" if before else ""
    return f"""SELECT o_custkey, o_orderpriority AS tier, nullif(o_orderstatus, 'P') AS status FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders {where}) WHERE rn = 1"""


_STATES = f"WITH old AS ({_state_sql(CUTOFF)}), new AS ({_state_sql()}), changes AS (SELECT o_custkey, o_orderpriority AS tier, nullif(o_orderstatus, 'P') AS status, o_orderdate, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}')"


@query("date_dim", """
    SELECT row_number() OVER (ORDER BY d) AS date_sk, d AS date_actual, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(day(d) AS INTEGER) AS day_of_month,
           CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name,
           left(monthname(d), 3) AS month_name_short, CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year, strftime(d, '%Y-%m') AS year_month,
           year(d) || '-Q' || quarter(d) AS year_quarter, isodow(d) >= 6 AS is_weekend, false AS is_holiday,
           CAST(CASE WHEN month(d) >= 7 THEN year(d) ELSE year(d) - 1 END AS INTEGER) AS fiscal_year, CAST(floor(((month(d) + 5) % 12) / 3) + 1 AS INTEGER) AS fiscal_quarter
    FROM (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM orders)""")
def date_dim(spark: SparkSession, sf: str) -> DataFrame:
    return dims.date_dimension_of(load(spark, sf, "orders"), "o_orderdate")


@query("time_dim", """
    SELECT CAST(hour(ts) * 4 + minute(ts) // 15 + 1 AS BIGINT) AS time_sk, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) // 15 * 15 AS VARCHAR), 2, '0') || ':00' AS time_actual,
           CAST(CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END AS INTEGER) AS hour_12, CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS am_pm,
           CASE WHEN hour(ts) < 6 THEN 'Night' WHEN hour(ts) < 12 THEN 'Morning' WHEN hour(ts) < 18 THEN 'Afternoon' ELSE 'Evening' END AS time_of_day,
           hour(ts) >= 9 AND hour(ts) < 17 AS is_business_hours, count(*) AS events
    FROM events GROUP BY ALL""")
def time_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Events per row of the time dimension."""
    events = load(spark, sf, "events").groupBy(star.time_slot("ts").alias("time_actual")).agg(F.count(F.lit(1)).alias("events"))
    return dims.time_dimension(spark).join(events, "time_actual").select("time_sk", "time_actual", "hour_12", "am_pm", "time_of_day", "is_business_hours", "events")


@query("dimension_mapping", """
    SELECT CAST(s_suppkey AS VARCHAR) AS provider_id, s_name AS first_name, NULL::VARCHAR AS specialty, 'MAIN' AS facility FROM supplier""")
def dimension_mapping(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["provider_id string", "first_name string", "specialty string", "facility string"]
    return dims.map_columns(load(spark, sf, "supplier"), columns, {"provider_id": "s_suppkey", "first_name": "s_name"}, {"facility": "MAIN"})


@query("upsert", _STATES + """
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN n.o_custkey IS NOT NULL THEN n.tier ELSE o.tier END AS tier,
           CASE WHEN o.o_custkey IS NULL THEN n.status ELSE o.status END AS status,
           CASE WHEN o.o_custkey IS NULL THEN 'inserted' WHEN n.o_custkey IS NULL THEN 'kept' ELSE 'updated' END AS _action
    FROM old o FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM changes) WHERE rn = 1) n ON o.o_custkey = n.o_custkey""")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Later orders update the tier of known customers and add the others; the last order per customer wins."""
    changes = load(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")).select(
        "o_custkey", F.col("o_orderpriority").alias("tier"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderdate", "o_orderkey")
    return scd.upsert(customer_state(spark, sf, CUTOFF), changes, ["o_custkey"], ["tier"], ["o_orderdate", "o_orderkey"])


_DAY, _BUCKETS = "2001-07-20", 128
_BUCKET = f"CAST('0x' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % {_BUCKETS}"


@query("upsert_touched", f"""
    WITH old AS ({_state_sql(_DAY)}), new AS (SELECT * FROM ({_state_sql()}) WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{_DAY}')),
    touched AS (SELECT DISTINCT {_BUCKET} AS b FROM new)
    SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, CASE WHEN n.o_custkey IS NOT NULL THEN n.tier ELSE o.tier END AS tier, CASE WHEN n.o_custkey IS NOT NULL THEN n.status ELSE o.status END AS status,
           (SELECT count(*) FROM touched) AS buckets_written, (SELECT count(DISTINCT {_BUCKET}) FROM old WHERE {_BUCKET} NOT IN (SELECT b FROM touched)) AS buckets_kept
    FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey""")
def upsert_touched(spark: SparkSession, sf: str) -> DataFrame:
    """The last days' orders merged into the customers' states: only the buckets of their customers are read and written."""
    path = scratch_path(spark, "customers")
    bucketed.create(customer_state(spark, sf, _DAY), path, ["o_custkey"], _BUCKETS)
    before = bucketed.snapshot(spark, path)
    changes = load(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(_DAY).cast("timestamp_ntz")).select(
        "o_custkey", F.col("o_orderpriority").alias("tier"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_orderdate", "o_orderkey")
    after = bucketed.merge(spark, path, changes, order_by=["o_orderdate", "o_orderkey"])
    figures = bucketed.files_left(spark, before, after).first()
    return after.rows(spark).withColumns({name: F.lit(figures[name]).cast("long") for name in ("buckets_written", "buckets_kept")})


@query("scd1", _STATES + """, k AS (SELECT *, row_number() OVER (ORDER BY o_custkey) AS customer_sk FROM old)
    SELECT coalesce(k.o_custkey, n.o_custkey) AS o_custkey, n.tier, n.status,
           coalesce(k.customer_sk, (SELECT count(*) FROM k) + row_number() OVER (PARTITION BY k.customer_sk IS NULL ORDER BY n.o_custkey)) AS customer_sk,
           CASE WHEN k.o_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS _action
    FROM k FULL JOIN new n ON k.o_custkey = n.o_custkey""")
def scd1(spark: SparkSession, sf: str) -> DataFrame:
    first = customer_state(spark, sf, CUTOFF).withColumn("customer_sk", F.lit(None).cast("bigint"))
    return scd.scd1(scd.assign_surrogate_keys(first, "customer_sk", ["o_custkey"]), customer_state(spark, sf), ["o_custkey"], "customer_sk")


def _versioned(rows: DataFrame, day: str) -> DataFrame:
    return rows.withColumns({"effective_date": F.lit(day).cast("date"), "end_date": F.lit(None).cast("date"), "is_current": F.lit(True)})


_SCD2 = _STATES + f""", j AS (SELECT o.o_custkey AS ok, o.tier AS ot, o.status AS os, n.o_custkey AS nk, n.tier AS nt, n.status AS ns,
        o.tier IS DISTINCT FROM n.tier OR o.status IS DISTINCT FROM n.status AS changed FROM old o FULL JOIN new n ON o.o_custkey = n.o_custkey),
    v AS (SELECT ok AS o_custkey, ot AS tier, os AS status, DATE '{CUTOFF}' AS effective_date, CASE WHEN nk IS NOT NULL AND changed THEN DATE '{AS_OF}' END AS end_date,
                 NOT (nk IS NOT NULL AND changed) AS is_current, CASE WHEN nk IS NULL THEN 'untouched' WHEN changed THEN 'expired' ELSE 'unchanged' END AS _action FROM j WHERE ok IS NOT NULL
          UNION ALL SELECT nk, nt, ns, DATE '{AS_OF}', NULL, true, CASE WHEN ok IS NULL THEN 'inserted' ELSE 'updated' END FROM j WHERE nk IS NOT NULL AND (ok IS NULL OR changed))"""


def _scd2(spark: SparkSession, sf: str) -> DataFrame:
    return scd.scd2(_versioned(customer_state(spark, sf, CUTOFF), CUTOFF), customer_state(spark, sf), ["o_custkey"], AS_OF)


@query("scd2", _SCD2 + " SELECT * FROM v")
def scd2(spark: SparkSession, sf: str) -> DataFrame:
    return _scd2(spark, sf)


@query("scd2_counts", _SCD2 + " SELECT count(CASE WHEN _action = 'inserted' THEN 1 END) AS inserted, count(CASE WHEN _action = 'updated' THEN 1 END) AS updated, count(CASE WHEN _action = 'unchanged' THEN 1 END) AS unchanged FROM v")
def scd2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scd.scd2_counts(_scd2(spark, sf))


@query("scd2_tracked", _SCD2.replace(" OR o.status IS DISTINCT FROM n.status", "") + " SELECT o_custkey, tier, effective_date AS valid_from, end_date AS valid_to, is_current AS current_flag FROM v")
def scd2_tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Only the tier decides about a new version; the version columns have other names."""
    first = _versioned(customer_state(spark, sf, CUTOFF), CUTOFF).withColumnsRenamed({"effective_date": "valid_from", "end_date": "valid_to", "is_current": "current_flag"})
    merged = scd.scd2(first, customer_state(spark, sf), ["o_custkey"], AS_OF, ["tier"], "valid_from", "valid_to", "current_flag")
    return merged.select("o_custkey", "tier", "valid_from", "valid_to", "current_flag")


@query("scd2_chain", _STATES + f""", seq AS (SELECT *, lag(tier) OVER w AS pt, row_number() OVER w AS n FROM changes WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    steps AS (SELECT s.o_custkey, s.tier, s.n, lead(s.n) OVER (PARTITION BY s.o_custkey ORDER BY s.n) IS NULL AS is_last, o.o_custkey IS NOT NULL AND s.n = 1 AND o.tier IS NOT DISTINCT FROM s.tier AS same
              FROM seq s LEFT JOIN old o ON s.o_custkey = o.o_custkey WHERE s.n = 1 OR s.tier IS DISTINCT FROM s.pt)
    SELECT o_custkey, tier, DATE '{AS_OF}' AS effective_date, CASE WHEN NOT is_last THEN DATE '{AS_OF}' END AS end_date, is_last AS is_current FROM steps WHERE NOT same
    UNION ALL SELECT o.o_custkey, o.tier, DATE '{CUTOFF}', CASE WHEN k.closes THEN DATE '{AS_OF}' END, NOT coalesce(k.closes, false) FROM old o
      LEFT JOIN (SELECT o_custkey, bool_or(NOT same) AS closes FROM steps GROUP BY o_custkey) k ON o.o_custkey = k.o_custkey""")
def scd2_chain(spark: SparkSession, sf: str) -> DataFrame:
    """All later orders as one batch: every change of the tier becomes a version."""
    target = _versioned(customer_state(spark, sf, CUTOFF).drop("status"), CUTOFF)
    batch = load(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")).select("o_custkey", F.col("o_orderpriority").alias("tier"), "o_orderdate", "o_orderkey")
    merged = scd.scd2(target, batch, ["o_custkey"], AS_OF, order_by=["o_orderdate", "o_orderkey"], chain=True)
    return merged.drop(scd.ACTION)


@query("surrogate_assignment", "SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS event_sk FROM events")
def surrogate_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Dense keys over a whole table, numbered in segments."""
    events = load(spark, sf, "events").select("event_id", "user_id", F.lit(None).cast("bigint").alias("event_sk"))
    return scd.assign_surrogate_keys(events, "event_sk", ["user_id", "event_id"], hot_rows=2000).select("event_id", "event_sk")


_SLOT = "lpad(CAST(hour({0}) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute({0}) // 15 * 15 AS VARCHAR), 2, '0') || ':00'"


def _date_sk(column: str, table: str) -> str:
    return f"date_diff('day', (SELECT min(CAST({column} AS DATE)) FROM {table}), CAST({column} AS DATE)) + 1"


def _time_sk(column: str) -> str:
    return f"CAST(hour({column}) * 4 + minute({column}) // 15 + 1 AS BIGINT)"


def _key(number: str, table: str) -> str:
    """Surrogate keys follow the natural keys in text order."""
    return f"(SELECT CAST({number} AS VARCHAR) AS nk, row_number() OVER (ORDER BY CAST({number} AS VARCHAR)) AS sk FROM {table})"


@query("star_health", with_views("patients", "encounters", "providers") + f"""
    SELECT md5(CAST(encounter_id AS VARCHAR)) AS encounter_sk, p.sk AS patient_sk, d.sk AS provider_sk, {_date_sk('encounter_date', 'encounters')} AS date_sk, {_time_sk('encounter_date')} AS time_sk,
           CASE encounter_type WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 END::BIGINT AS encounter_type_sk, CAST(encounter_id AS VARCHAR) AS encounter_id, total_charges
    FROM encounters e LEFT JOIN {_key('patient_id', 'patients')} p ON p.nk = CAST(e.patient_id AS VARCHAR) LEFT JOIN {_key('provider_id', 'providers')} d ON d.nk = CAST(e.provider_id AS VARCHAR)""")
def star_health(spark: SparkSession, sf: str) -> DataFrame:
    data = {n: view(spark, sf, n) for n in ("patients", "encounters", "providers")}
    kinds = {"1-URGENT": "EMERGENCY", "2-HIGH": "INPATIENT", "3-MEDIUM": "OUTPATIENT", "5-LOW": "TELEHEALTH"}  # the others have no known type
    data["encounters"] = data["encounters"].replace(kinds, subset=["encounter_type"])
    tables = star.build_health(data, AS_OF, spark)
    return tables["fact_encounter"].select("encounter_sk", "patient_sk", "provider_sk", "date_sk", "time_sk", "encounter_type_sk", "encounter_id", "total_charges")


@query("star_finance", with_views("accounts", "transactions") + f"""
    , m AS (SELECT replace(lower(merchant_name), ' ', '_') AS nk, row_number() OVER (ORDER BY replace(lower(merchant_name), ' ', '_')) AS sk FROM (SELECT DISTINCT merchant_name FROM transactions WHERE merchant_name IS NOT NULL))
    SELECT md5(CAST(transaction_id AS VARCHAR)) AS transaction_sk, a.sk AS account_sk, c.sk AS customer_sk, m.sk AS merchant_sk, {_date_sk('transaction_date', 'transactions')} AS date_sk, {_time_sk('transaction_date')} AS time_sk,
           CAST(transaction_id AS VARCHAR) AS transaction_id, amount, CAST(fraud_score AS INTEGER) AS fraud_score, is_flagged
    FROM transactions t LEFT JOIN {_key('account_number', 'accounts')} a ON a.nk = CAST(t.account_id AS VARCHAR) LEFT JOIN {_key('customer_id', 'accounts')} c ON c.nk = CAST(t.account_id AS VARCHAR)
    LEFT JOIN m ON m.nk = replace(lower(t.merchant_name), ' ', '_')""")
def star_finance(spark: SparkSession, sf: str) -> DataFrame:
    tables = star.build_finance({n: view(spark, sf, n) for n in ("accounts", "transactions")}, AS_OF, spark)
    return tables["fact_transaction"].select("transaction_sk", "account_sk", "customer_sk", "merchant_sk", "date_sk", "time_sk", "transaction_id", "amount", "fraud_score", "is_flagged")


@query("star_tech", with_views("servers", "metrics") + f"""
    SELECT md5(CAST(metric_id AS VARCHAR)) AS metric_sk, s.sk AS server_sk, {_date_sk('timestamp', 'metrics')} AS date_sk, {_time_sk('timestamp')} AS time_sk, CAST(cpu_usage_pct AS DOUBLE) AS cpu_usage_pct, CAST(memory_used_pct AS DOUBLE) AS memory_used_pct
    FROM metrics m LEFT JOIN {_key('server_id', 'servers')} s ON s.nk = CAST(m.server_id AS VARCHAR)""")
def star_tech(spark: SparkSession, sf: str) -> DataFrame:
    tables = star.build_tech({n: view(spark, sf, n) for n in ("servers", "metrics", "applications")}, AS_OF, spark)
    return tables["fact_server_metric"].select("metric_sk", "server_sk", "date_sk", "time_sk", "cpu_usage_pct", "memory_used_pct")


@query("star_university", with_views("students", "courses", "enrollments", "faculty") + f"""
    SELECT md5(enrollment_id) AS enrollment_sk, s.sk AS student_sk, c.sk AS course_sk, i.sk AS instructor_sk,
           CAST(CASE k.term WHEN 'FALL_2023' THEN 1 WHEN 'FALL_2024' THEN 2 ELSE 3 END AS BIGINT) AS term_sk, enrollment_id, grade_points
    FROM enrollments e JOIN courses k ON e.course_id = k.course_id LEFT JOIN {_key('student_id', 'students')} s ON s.nk = CAST(e.student_id AS VARCHAR)
    LEFT JOIN {_key('course_code', 'courses')} c ON c.nk = k.course_code LEFT JOIN {_key('faculty_id', 'faculty')} i ON i.nk = CAST(k.instructor_id AS VARCHAR)""")
def star_university(spark: SparkSession, sf: str) -> DataFrame:
    tables = star.build_university({n: view(spark, sf, n) for n in ("students", "courses", "enrollments", "faculty")}, AS_OF, spark)
    return tables["fact_enrollment"].select("enrollment_sk", "student_sk", "course_sk", "instructor_sk", "term_sk", "enrollment_id", "grade_points")


@query("dim_customer", with_views("accounts") + f"""
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, customer_name, customer_type, row_number() OVER (ORDER BY CAST(customer_id AS VARCHAR)) AS customer_sk,
           DATE '{AS_OF}' AS effective_date, NULL::DATE AS expiration_date, true AS is_current FROM accounts""")
def dim_customer(spark: SparkSession, sf: str) -> DataFrame:
    tables = star.build_finance({n: view(spark, sf, n) for n in ("accounts", "transactions")}, AS_OF, spark, only=["dim_customer"])
    return tables["dim_customer"].select("customer_id", "customer_name", "customer_type", "customer_sk", "effective_date", "expiration_date", "is_current")


@query("star_saved", """
    SELECT 'dim_date' AS table_name, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS row_count FROM events UNION ALL SELECT 'dim_time', 96
    UNION ALL SELECT 'dim_server', count(*) FROM supplier UNION ALL SELECT 'dim_application', count(*) FROM part UNION ALL SELECT 'fact_server_metric', count(*) FROM events""")
def star_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Write the tech star and count what was written."""
    tables = star.build_tech({n: view(spark, sf, n) for n in ("servers", "metrics", "applications")}, AS_OF, spark)
    path = scratch_path(spark, "star")
    star.save(tables, star.TECH.name, path)
    return star.table_counts(spark, list(tables), star.TECH.name, path)


@query("star_orphans", """
    SELECT 'l_partkey' AS foreign_key, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)
    UNION ALL SELECT 'l_suppkey', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def star_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return star.star_orphans(load(spark, sf, "lineitem"), {
        "l_partkey": (load(spark, sf, "part").where("p_size > 10"), "p_partkey"), "l_suppkey": (load(spark, sf, "supplier"), "s_suppkey"),
    })
