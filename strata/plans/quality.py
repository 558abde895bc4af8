"""Rules, profiles, drift, scores and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.joins import orphans
from strata.plans.registry import query
from strata.quality import monitor, profile, rules, sketches
from strata.session import scratch_path
from strata.tables import VIEWS, load, view, with_views

RUN_TS = "2024-06-30 12:00:00"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with gaps: no status for P, priority blank for LOW, price as text with some words."""
    return load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.year("o_orderdate") == 1995, "unknown").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"),
    )


ORDERS = """WITH o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE o_orderpriority END AS priority,
    CASE WHEN year(o_orderdate) = 1995 THEN 'unknown' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price FROM orders)"""

ORDER_RULES = [
    rules.required("status"), rules.required("priority", rules.WARNING), rules.type_check("o_custkey", "string", rules.INFO),
    rules.range_check("price", 2000, 400000), rules.pattern("priority", r"\d-[A-Z]+", rules.WARNING), rules.enum_check("status", ["F"], rules.WARNING),
    rules.custom("o_custkey", lambda c: c > 100, "reserved number", rules.WARNING), rules.unique("o_custkey"),
]
_FAILURES = """, u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, TRY_CAST(price AS DOUBLE) AS p FROM o),
    f AS (SELECT o_orderkey, 'required' AS rule_name, 'status' AS field_name, 'ERROR' AS severity, 'Field ''status'' is required but missing or empty' AS message, status AS failed_value FROM u WHERE status IS NULL
    UNION ALL SELECT o_orderkey, 'required', 'priority', 'WARNING', 'Field ''priority'' is required but missing or empty', priority FROM u WHERE trim(priority) = ''
    UNION ALL SELECT o_orderkey, 'type_check', 'o_custkey', 'INFO', 'Field ''o_custkey'' expected string, got bigint', CAST(o_custkey AS VARCHAR) FROM u
    UNION ALL SELECT o_orderkey, 'range_check', 'price', 'ERROR', CASE WHEN p IS NULL THEN 'Field ''price'' value ''' || price || ''' is not numeric'
        WHEN p < 2000 THEN 'Field ''price'' value ' || price || ' is below minimum 2000' ELSE 'Field ''price'' value ' || price || ' exceeds maximum 400000' END, price FROM u WHERE p IS NULL OR p < 2000 OR p > 400000
    UNION ALL SELECT o_orderkey, 'pattern', 'priority', 'WARNING', 'Field ''priority'' value ''' || priority || ''' does not match pattern', priority FROM u WHERE NOT regexp_matches(priority, '^\\d-[A-Z]+')
    UNION ALL SELECT o_orderkey, 'enum_check', 'status', 'WARNING', 'Field ''status'' value ''' || status || ''' not in allowed values', status FROM u WHERE status <> 'F'
    UNION ALL SELECT o_orderkey, 'custom', 'o_custkey', 'WARNING', 'Field ''o_custkey'': reserved number', CAST(o_custkey AS VARCHAR) FROM u WHERE o_custkey <= 100
    UNION ALL SELECT o_orderkey, 'unique', 'o_custkey', 'ERROR', 'Field ''o_custkey'' value ''' || o_custkey || ''' is not unique', CAST(o_custkey AS VARCHAR) FROM u WHERE rn > 1)"""
_FAILURES = _FAILURES.replace("\\\\", "\\")
_REPORT = """ SELECT count(*) AS total_records, count(CASE WHEN coalesce(e, 0) = 0 THEN 1 END) AS valid_records, count(CASE WHEN e > 0 THEN 1 END) AS invalid_records,
    round(count(CASE WHEN coalesce(e, 0) = 0 THEN 1 END) / count(*), 4) AS validity_rate, CAST(coalesce(sum(e), 0) AS BIGINT) AS error_count, CAST(coalesce(sum(w), 0) AS BIGINT) AS warning_count
    FROM o LEFT JOIN (SELECT o_orderkey, count(CASE WHEN severity = 'ERROR' THEN 1 END) AS e, count(CASE WHEN severity = 'WARNING' THEN 1 END) AS w FROM f GROUP BY o_orderkey) USING (o_orderkey)"""


@query("rule_engine", ORDERS + _FAILURES + " SELECT CAST(o_orderkey AS VARCHAR) AS record_id, * EXCLUDE (o_orderkey) FROM f")
def rule_engine(spark: SparkSession, sf: str) -> DataFrame:
    return rules.failures(_orders(spark, sf), ORDER_RULES, "o_orderkey")


@query("rule_report", ORDERS + _FAILURES + _REPORT)
def rule_report(spark: SparkSession, sf: str) -> DataFrame:
    return rules.report(_orders(spark, sf), ORDER_RULES, ["o_orderkey"])


@query("sample_failures", ORDERS + _FAILURES + " SELECT CAST(o_orderkey AS VARCHAR) AS record_id, rule_name, field_name FROM f ORDER BY o_orderkey, rule_name, field_name LIMIT 20")
def sample_failures(spark: SparkSession, sf: str) -> DataFrame:
    rows = rules.failures(_orders(spark, sf), ORDER_RULES, "o_orderkey")
    return rows.orderBy(F.col("record_id").cast("bigint"), "rule_name", "field_name").limit(20).select("record_id", "rule_name", "field_name")


@query("schema_rules", """
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS record_id, rule_name, field_name FROM (
      SELECT *, 'range_check' AS rule_name, 'l_quantity' AS field_name FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45
      UNION ALL SELECT *, 'enum_check', 'l_returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
      UNION ALL SELECT *, 'type_check', 'l_tax' FROM lineitem)""")
def schema_rules(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"l_quantity": {"type": "float", "min": 5, "max": 45, "required": True}, "l_returnflag": {"type": "string", "enum": ["A", "N"]}, "l_tax": {"type": "decimal"}}
    items = load(spark, sf, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return rules.failures(items, rules.from_schema(spec), "id").select("record_id", "rule_name", "field_name")


@query("business_rules", """
    SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'large orders are urgent' AS rule_name, 'WARNING' AS severity, 'large order without priority' AS message
    FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_totalprice < 450000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'large orders are urgent', 'ERROR', 'Rule could not be evaluated' FROM orders
    WHERE o_orderstatus = 'P' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def business_rules(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("known_price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    condition = (F.col("known_price") < 450000) | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    rule = rules.business("large orders are urgent", condition, "large order without priority", rules.WARNING)
    return rules.failures(orders, [rule], "o_orderkey").select("record_id", "rule_name", "severity", "message")


@query("uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return rules.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("constraints", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(nullif(c_acctbal, 0) >= 0, true)")
def constraints(spark: SparkSession, sf: str) -> DataFrame:
    return rules.check_constraint(load(spark, sf, "customer"), F.nullif(F.col("c_acctbal"), F.lit(0.0)) >= 0).select("c_custkey", "c_acctbal")


@query("orphan_keys", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def orphan_keys(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(load(spark, sf, "lineitem"), "l_orderkey", load(spark, sf, "orders").where("o_orderstatus <> 'P'"), "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


def _profile_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """Column profile in plain SQL; kind is int, float, string or date."""
    parts = []
    for name, kind in columns:
        number, text = kind in ("int", "float"), kind == "string"
        value = f"CAST({name} AS DOUBLE)"
        exact = f"CAST(sum(CAST({name} AS DECIMAL(18,2))) AS DOUBLE)"
        parts.append(
            f"SELECT '{name}' AS column_name, '{kind}' AS data_type, count(*) AS total_count, count(*) - count({name}) AS null_count, round((count(*) - count({name})) / count(*), 4) AS null_rate, "
            f"count(DISTINCT {name}) AS unique_count, round(count(DISTINCT {name}) / count({name}), 4) AS uniqueness_rate, round(1 - (count(*) - count({name})) / count(*), 4) AS completeness, "
            + (f"min({value}) AS min_value, max({value}) AS max_value, round(avg({value}), 4) AS mean_value, median({value}) AS median_value, round(stddev_samp({value}), 4) AS std_dev, {exact} AS sum_value, " if number
               else "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value, NULL::DOUBLE AS median_value, NULL::DOUBLE AS std_dev, NULL::DOUBLE AS sum_value, ")
            + (f"CAST(min(length({name})) AS BIGINT) AS min_length, CAST(max(length({name})) AS BIGINT) AS max_length, round(avg(length({name})), 2) AS avg_length" if text
               else "NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, NULL::DOUBLE AS avg_length")
            + f" FROM {table}")
    return " UNION ALL ".join(parts)


_ORDER_COLUMNS = [("o_orderkey", "int"), ("o_custkey", "int"), ("status", "string"), ("o_totalprice", "float"), ("o_orderdate", "date"), ("day_text", "date")]
_ORDER_TABLE = "(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_totalprice, o_orderdate, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_text FROM orders)"


def _profiled(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    return load(spark, sf, "orders").where(where).select(
        "o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), "o_totalprice", "o_orderdate",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"))


@query("profile_columns", _profile_sql(_ORDER_TABLE, _ORDER_COLUMNS))
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    table = profile.profile_columns(_profiled(spark, sf))
    return table.withColumn("sum_value", F.round("sum_value", 2))


@query("profile_text", _profile_sql("documents", [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int")]))
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_columns(load(spark, sf, "documents"))


@query("profile_dataset", f"""
    SELECT 'orders' AS name, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS duplicate_row_count, 0.0::DOUBLE AS duplicate_rate,
           round((5 + count(status) / count(*)) / 6, 4) AS overall_completeness FROM {_ORDER_TABLE}""")
def profile_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_dataset(_profiled(spark, sf), "orders")


@query("drift", f"""
    WITH a AS ({_profile_sql(_ORDER_TABLE + " WHERE o_orderdate < TIMESTAMP '1998-01-01'", _ORDER_COLUMNS)}),
         b AS ({_profile_sql("(SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 THEN nullif(o_orderstatus, 'P') END AS status, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderdate, o_orderpriority FROM orders)",
                             [("o_orderkey", "int"), ("o_custkey", "int"), ("status", "string"), ("o_orderdate", "date"), ("o_orderpriority", "string")])}
               UNION ALL SELECT 'o_totalprice', 'string', count(*), 0, 0.0, count(DISTINCT o_totalprice), 0, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders)
    SELECT * FROM (
      SELECT coalesce(a.column_name, b.column_name) AS column_name, a.null_rate AS null_rate_before, b.null_rate AS null_rate_after, a.data_type AS data_type_before, b.data_type AS data_type_after,
             a.unique_count AS unique_count_before, b.unique_count AS unique_count_after, coalesce(abs(a.null_rate - b.null_rate) > 0.05, false) AS null_rate_changed,
             coalesce(a.data_type <> b.data_type, false) AS data_type_changed, coalesce(a.unique_count <> b.unique_count, false) AS unique_count_changed,
             CASE WHEN a.column_name IS NULL THEN 'added' WHEN b.column_name IS NULL THEN 'removed'
                  WHEN abs(a.null_rate - b.null_rate) > 0.05 OR a.data_type <> b.data_type OR a.unique_count <> b.unique_count THEN 'modified' END AS change
      FROM a FULL JOIN b ON a.column_name = b.column_name) WHERE change IS NOT NULL""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    """Orders before 1998 against all orders with another price type, more gaps, one column less and one more."""
    before = profile.profile_columns(_profiled(spark, sf, "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"), medians=False)
    changed = load(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 100000, F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("status"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderdate", "o_orderpriority")
    return profile.drift(before, profile.profile_columns(changed, medians=False))


@query("profile_merged", f"""
    SELECT column_name, data_type, total_count, null_count, null_rate, completeness, min_value, max_value, mean_value, std_dev, sum_value, min_length, max_length, avg_length, true AS distinct_near, true AS median_near
    FROM ({_profile_sql(_ORDER_TABLE, _ORDER_COLUMNS)})""")
def profile_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a load for each year: each load leaves its state, the profile of all comes from the states alone.

    Distinct values have to be within 5 %, medians between the exact quantiles 0.47 and 0.53.
    """
    orders, store = _profiled(spark, sf), scratch_path(spark, "states")
    for year in range(1992, 2002, 2):
        sketches.save(sketches.state(orders.where(_load_of(year))), store, str(year))
    exact = profile.profile_columns(orders, medians=False).select("column_name", F.col("unique_count").alias("exact"))
    numbers = [r["column_name"] for r in exact.collect() if isinstance(orders.schema[r["column_name"]].dataType, T.NumericType)]
    bounds = orders.agg(*[F.percentile(F.col(c).cast("double"), F.array(F.lit(0.47), F.lit(0.53))).alias(c) for c in numbers]).select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high")) for c in numbers])))
    merged = sketches.profile(sketches.stored(spark, store)).join(exact, "column_name").join(bounds, "column_name", "left")
    return merged.select(
        "column_name", "data_type", "total_count", "null_count", "null_rate", "completeness", "min_value", "max_value", "mean_value", "std_dev", F.round("sum_value", 2).alias("sum_value"),
        "min_length", "max_length", "avg_length", (F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_near"),
        F.coalesce(F.col("median_value").between(F.col("low"), F.col("high")), F.lit(True)).alias("median_near"),
    )


def _load_of(year: int) -> Column:
    """Orders of a load of two years; those before the first and after the last count to them."""
    ordered = F.year("o_orderdate")
    low = F.lit(True) if year == 1992 else ordered >= year
    return F.coalesce(low & (F.lit(True) if year == 2000 else ordered < year + 2), F.lit(year == 2000))


@query("dataset_drift", """
    WITH a AS (SELECT count(*) AS n, round((5 + count(nullif(o_orderstatus, 'P')) / count(*)) / 6, 4) AS c FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
         b AS (SELECT count(*) AS n, round((5 + count(nullif(o_orderstatus, 'P')) / count(*)) / 6, 4) AS c FROM orders)
    SELECT 'old' AS before_name, 'all' AS after_name, b.n - a.n AS row_count_diff, round((b.n - a.n) / a.n * 100, 4) AS row_count_change_pct, round(b.c - a.c, 4) AS completeness_diff FROM a, b""")
def dataset_drift(spark: SparkSession, sf: str) -> DataFrame:
    old = profile.profile_dataset(_profiled(spark, sf, "o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"), "old")
    return profile.dataset_drift(old, profile.profile_dataset(_profiled(spark, sf), "all"))


def _form(column: str, prefix: str, digits: int) -> str:
    """An id in the required form for two of three rows."""
    return f"CASE WHEN {column} % 3 > 0 THEN '{prefix}' || lpad(CAST({column} AS STRING), {digits}, '0') ELSE CAST({column} AS STRING) END"


# Ids as the patterns of the rule sets want them, and the columns that the patterns of e-mails look at.
_FORMS = {
    "patients": {"patient_id": _form("patient_id", "PAT", 8)}, "accounts": {"account_number": _form("account_number", "ACC", 10)},
    "servers": {"server_id": _form("server_id", "SRV-US-", 4)},
    "students": {"student_id": _form("student_id", "STU", 8), "email": "CASE WHEN student_id % 5 = 0 THEN 'é' || last_name || '@uni.edu' WHEN student_id % 5 < 4 THEN last_name || '@uni.edu' ELSE last_name END"},
}
_DOMAINS = [
    ("health", "patients", "patient_id", ["patient_id", "first_name", "last_name", "date_of_birth", "gender", "city", "state", "is_deceased"],
     "coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '' AND date_of_birth IS NOT NULL AND patient_id LIKE 'PAT________'"),
    ("finance", "accounts", "account_number", ["account_number", "customer_id", "customer_name", "customer_type", "account_type", "current_balance", "aml_risk_score", "status"],
     "account_type IN ('CHECKING', 'SAVINGS', 'MONEY_MARKET', 'CD', 'BROKERAGE', 'CREDIT_CARD') AND account_number LIKE 'ACC__________'"),
    ("tech", "servers", "server_id", ["server_id", "hostname", "status", "environment", "datacenter"], "environment IN ('PROD', 'STAGING', 'DEV', 'QA') AND server_id LIKE 'SRV-US-____'"),
    ("university", "students", "student_id", ["student_id", "first_name", "last_name", "gpa", "major", "enrollment_status", "academic_level", "email"],
     "first_name <> '' AND last_name <> '' AND gpa BETWEEN 0 AND 4 AND student_id LIKE 'STU________' AND email LIKE '%_@uni.edu'"),
]


def _formed_sql(entity: str) -> str:
    forms = _FORMS[entity]
    fresh = "".join(f", {e} AS {n}" for n, e in forms.items() if n not in VIEWS[entity].columns)
    return f"SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in forms.items() if n in VIEWS[entity].columns)}){fresh} FROM {entity}"


def _score_sql(domain: str, entity: str, key: str, columns: list[str], valid: str) -> str:
    complete = " + ".join(f"count({c}) / count(*)" for c in columns)
    return f"""SELECT '{domain}' AS name, count(*) AS row_count, 100 * ({complete}) / {len(columns)} AS completeness, 100 * count(DISTINCT {key}) / count({key}) AS uniqueness,
        100 * count(CASE WHEN {valid} THEN 1 END) / count(*) AS validity, 100 * count(DISTINCT ({', '.join(columns)})) / count(*) AS consistency FROM ({_formed_sql(entity)})"""


_SCORES = with_views("patients", "accounts", "servers", "students") + ", parts AS (" + " UNION ALL ".join(_score_sql(*d) for d in _DOMAINS) + """),
    scored AS (SELECT *, completeness * 0.3 + uniqueness * 0.2 + validity * 0.3 + consistency * 0.2 AS s FROM parts)"""


def domain_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Profile, validate and score the main table of every domain."""
    result = None
    for domain, entity, key, columns, _ in _DOMAINS:
        rows = view(spark, sf, entity).withColumns({n: F.expr(e) for n, e in _FORMS[entity].items()}).select(*columns)
        score = profile.quality_score(profile.profile_columns(rows, medians=False), profile.profile_dataset(rows, domain), key, rules.report(rows, rules.DOMAIN_RULES[domain]), domain)
        result = score if result is None else result.unionByName(score)
    return result


@query("catalogue_rules", with_views("transactions", "metrics", "students") + f"""
    , f AS (SELECT 'finance' AS domain, 'account_number' AS field, 'pattern' AS rule FROM transactions WHERE account_id % 3 = 0
      UNION ALL SELECT 'finance', 'amount', 'range_check' FROM transactions WHERE amount > 1e12
      UNION ALL SELECT 'tech', 'server_id', 'pattern' FROM metrics WHERE server_id % 3 = 0
      UNION ALL SELECT 'tech', 'cpu_usage', 'range_check' FROM metrics WHERE cpu_usage_pct * 1.5 > 100
      UNION ALL SELECT 'tech', 'memory_usage', 'type_check' FROM metrics
      UNION ALL SELECT 'university', 'student_id', 'pattern' FROM students WHERE student_id % 3 = 0
      UNION ALL SELECT 'university', 'gpa', 'type_check' FROM students
      UNION ALL SELECT 'university', 'gpa', 'range_check' FROM students WHERE gpa * 1.2 > 4
      UNION ALL SELECT 'university', 'enrollment_status', 'enum_check' FROM students WHERE enrollment_status = 'GRADUATED')
    SELECT domain, field, rule, count(*) AS failures FROM f GROUP BY ALL""")
def catalogue_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of the rule catalogue by domain, field and rule."""
    tables = {
        "finance": view(spark, sf, "transactions").select(F.expr(_form("account_id", "ACC", 10)).alias("account_number"), F.col("amount").cast("decimal(18,2)").cast("string").alias("amount"), "transaction_type"),
        "tech": view(spark, sf, "metrics").select(F.expr(_form("server_id", "SRV-US-", 4)).alias("server_id"), (F.col("cpu_usage_pct") * 1.5).alias("cpu_usage"), F.lit("50").alias("memory_usage")),
        "university": view(spark, sf, "students").select(F.expr(_form("student_id", "STU", 8)).alias("student_id"), (F.col("gpa") * 1.2).cast("string").alias("gpa"), F.when(F.col("enrollment_status") == "GRADUATED", "ALUMNI").otherwise(F.col("enrollment_status")).alias("enrollment_status")),
    }
    result = None
    for domain, rows in tables.items():
        known = rules.from_schema({n: e for n, e in rules.CATALOGUE[domain].items() if n in rows.columns})
        failed = rules.checked(rows, known).select(F.explode("_failures").alias("f")).select(F.lit(domain).alias("domain"), F.col("f.field_name").alias("field"), F.col("f.rule_name").alias("rule"))
        result = failed if result is None else result.unionByName(failed)
    return result.groupBy("domain", "field", "rule").agg(F.count(F.lit(1)).alias("failures"))


@query("threshold_alerts", _SCORES + """
    , m AS (SELECT name || '.completeness' AS metric, completeness / 100 AS value, 0.95 AS threshold FROM parts UNION ALL SELECT name || '.uniqueness', uniqueness / 100, 1.0 FROM parts
      UNION ALL SELECT name || '.validity', validity / 100, 0.98 FROM parts UNION ALL SELECT name || '.consistency', consistency / 100, 0.99 FROM parts)
    SELECT metric AS metric_name, round(value, 4) AS metric_value, threshold::DOUBLE AS threshold FROM m WHERE round(value, 4) < threshold""")
def threshold_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts where a part of a domain's score is below its threshold."""
    parts = ("completeness", "uniqueness", "validity", "consistency")
    tall = domain_scores(spark, sf).unpivot(["name"], list(parts), "part", "percent")
    metrics = tall.select(F.concat("name", F.lit("."), "part").alias("metric"), F.round(F.col("percent") / 100, 4).alias("value"))
    found = monitor.alerts(metrics, [r for d in rules.DOMAIN_RULES for r in monitor.threshold_rules(d)], RUN_TS)
    return found.select("metric_name", "metric_value", "threshold")


@query("domain_quality", _SCORES + """
    SELECT name, row_count, round(s, 2) AS overall_score, round(completeness, 2) AS completeness, round(uniqueness, 2) AS uniqueness, round(validity, 2) AS validity, round(consistency, 2) AS consistency,
           CASE WHEN s >= 95 THEN 'A+' WHEN s >= 90 THEN 'A' WHEN s >= 85 THEN 'B+' WHEN s >= 80 THEN 'B' WHEN s >= 75 THEN 'C+' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored""")
def domain_quality(spark: SparkSession, sf: str) -> DataFrame:
    return domain_scores(spark, sf)


@query("quality_gate", _SCORES + """
    SELECT round(avg(round(s, 2)), 4) AS avg_score, CASE WHEN avg(round(s, 2)) >= 80 THEN 'transform' ELSE 'quality_alert' END AS branch FROM scored""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.quality_gate(domain_scores(spark, sf))


def _monitor_rules() -> list[monitor.MonitorRule]:
    return [
        monitor.completeness_rule("status", 0.95), monitor.completeness_rule("o_orderkey", 1.0), monitor.uniqueness_rule("o_custkey", 1.0),
        *monitor.row_count_rules(minimum=1, maximum=1000), monitor.freshness_rule(24),
        monitor.MonitorRule("mean_price", "columns.o_totalprice.mean_value", "gte", 1000.0, "LOW", "Mean price too high"),
        monitor.MonitorRule("off", "row_count", "gt", 0, enabled=False),
    ]


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    orders = _profiled(spark, sf)
    return monitor.metrics_frame(profile.profile_columns(orders, medians=False), profile.profile_dataset(orders, "orders"), monitor.freshness(orders, "o_orderdate", "2001-09-01 00:00:00"))


def _alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.alerts(_metrics(spark, sf), _monitor_rules(), RUN_TS)


_ALERTS = """WITH m AS (SELECT round(count(nullif(o_orderstatus, 'P')) / count(*), 4) AS c, round(count(DISTINCT o_custkey) / count(o_custkey), 4) AS u, count(*) AS n,
        (epoch_us(TIMESTAMP '2001-09-01') - epoch_us(max(o_orderdate))) / 3600000000 AS age, round(avg(o_totalprice), 4) AS p FROM orders),
    r AS (SELECT 0 AS no, 'HIGH' AS severity, 'completeness_status' AS title, 'columns.status.completeness' AS metric_name, c AS metric_value, 0.95::DOUBLE AS threshold FROM m WHERE c < 0.95
      UNION ALL SELECT 2, 'HIGH', 'uniqueness_o_custkey', 'columns.o_custkey.uniqueness_rate', u, 1.0 FROM m WHERE u < 1
      UNION ALL SELECT 4, 'MEDIUM', 'max_row_count', 'row_count', n, 1000.0 FROM m WHERE n > 1000
      UNION ALL SELECT 5, 'HIGH', 'data_freshness', 'age_hours', age, 24.0 FROM m WHERE age > 24
      UNION ALL SELECT 6, 'LOW', 'mean_price', 'columns.o_totalprice.mean_value', p, 1000.0 FROM m WHERE p >= 1000),
    a AS (SELECT *, 'ALT-20240630-' || lpad(CAST(row_number() OVER (ORDER BY no) AS VARCHAR), 4, '0') AS alert_id FROM r)"""


@query("monitor_alerts", _ALERTS + f" SELECT alert_id, severity, title, metric_name, metric_value, threshold, TIMESTAMP '{RUN_TS}' AS created_at, false AS acknowledged FROM a")
def monitor_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _alert_rows(spark, sf).select("alert_id", "severity", "title", "metric_name", "metric_value", "threshold", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "acknowledged")


@query("active_alerts", _ALERTS + " SELECT alert_id, title FROM a WHERE severity = 'HIGH' AND alert_id <> 'ALT-20240630-0001'")
def active_alerts(spark: SparkSession, sf: str) -> DataFrame:
    handled = monitor.acknowledge(_alert_rows(spark, sf), "ALT-20240630-0001", "ops", RUN_TS)
    return monitor.active_alerts(handled, "HIGH").select("alert_id", "title")


@query("routed_alerts", _ALERTS + " SELECT alert_id, severity, CASE WHEN severity = 'HIGH' THEN 'pager' ELSE 'mail' END AS channel FROM a WHERE severity IN ('HIGH', 'MEDIUM')")
def routed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """High alerts to one folder, medium ones to another; both are read back."""
    base = scratch_path(spark, "alerts")
    monitor.route(_alert_rows(spark, sf), {
        "HIGH": [lambda rows: monitor.append_alerts(rows, f"{base}/channel=pager")], "MEDIUM": [lambda rows: monitor.append_alerts(rows, f"{base}/channel=mail")],
    })
    return spark.read.schema("alert_id string, severity string, channel string").json(base).select("alert_id", "severity", "channel")


@query("freshness", "SELECT (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 3600000000 AS age_hours FROM events")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.freshness(load(spark, sf, "events"), "ts", "2024-02-01 00:00:00")


@query("metric_trend", """
    SELECT run_ts, value FROM (
      SELECT TIMESTAMP '2024-01-01' AS run_ts, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
      UNION ALL SELECT TIMESTAMP '2024-01-02', CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
      UNION ALL SELECT TIMESTAMP '2024-01-03', CAST(count(*) AS DOUBLE) FROM orders) ORDER BY run_ts DESC LIMIT 2""")
def metric_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs are kept in the history table; the last two are asked for."""
    path = scratch_path(spark, "history")
    for day, limit in (("2024-01-01", "1996-01-01"), ("2024-01-02", "1998-01-01"), ("2024-01-03", "2100-01-01")):
        rows = load(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(limit).cast("timestamp_ntz"))
        metric = rows.agg(F.lit("row_count").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))
        monitor.append_history(metric, "orders", f"{day} 00:00:00", path)
    return monitor.trend(spark.read.parquet(path), "orders", "row_count", 2).select(F.col("run_ts").cast("timestamp_ntz").alias("run_ts"), "value")


@query("random_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('42:' || o_orderkey) LIMIT 100")
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A random sample of 100 orders, the same for every partitioning."""
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return profile.sample_rows(orders, 100, key=["o_orderkey"])
