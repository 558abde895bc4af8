"""Whole-record steps and their chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import chain as chains
from strata.operators import dedup, joins, transforms
from strata.plans.registry import query
from strata.session import scratch_path
from strata.tables import load

RUN_TS = "2024-06-30 12:00:00"


def dirty_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with padded names, null tokens, and dates and numbers in text form."""
    return load(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") == 3, " N/A ").otherwise(F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  "))).alias("name"),
        F.concat(F.lower("c_name"), F.when(F.col("c_acctbal") < 0, "@a@b").otherwise("@Example.COM")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"),
        F.lower("c_mktsegment").alias("state"),
        F.when(F.col("c_acctbal") < 500, "NULL").otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("balance"),
        F.when(F.col("c_nationkey") == 7, "31/12/x").otherwise(F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("/03/1999"))).alias("since"),
    )


DIRTY = """WITH dirty AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN ' N/A ' ELSE ' ' || chr(9) || c_name || '  ' END AS name,
    lower(c_name) || CASE WHEN c_acctbal < 0 THEN '@a@b' ELSE '@Example.COM' END AS email, '555-' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone,
    lower(c_mktsegment) AS state, CASE WHEN c_acctbal < 500 THEN 'NULL' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS balance,
    CASE WHEN c_nationkey = 7 THEN '31/12/x' ELSE lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || '/03/1999' END AS since FROM customer) """

CLEAN = r"""SELECT c_custkey, nullif(regexp_replace(name, '^\s+|\s+$', '', 'g'), 'N/A') AS name, lower(email) AS email, phone, upper(state) AS state,
    TRY_CAST(nullif(balance, 'NULL') AS DOUBLE) AS balance, CAST(try_strptime(since, '%d/%m/%Y') AS TIMESTAMP) AS since FROM dirty"""


def _cleansed(df: DataFrame) -> DataFrame:
    clean = transforms.cleanse(df, lowercase_columns=["email"], uppercase_columns=["state"], date_columns={"since": "%d/%m/%Y"}, numeric_columns=["balance"])
    return clean.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("cleanse", DIRTY + CLEAN)
def cleanse(spark: SparkSession, sf: str) -> DataFrame:
    return _cleansed(dirty_customers(spark, sf))


@query("cleanse_critical", DIRTY + f"SELECT c_custkey, name, balance FROM ({CLEAN}) WHERE name IS NOT NULL AND balance IS NOT NULL")
def cleanse_critical(spark: SparkSession, sf: str) -> DataFrame:
    clean = transforms.cleanse(dirty_customers(spark, sf), numeric_columns=["balance"], critical_columns=["name", "balance"])
    return clean.select("c_custkey", "name", "balance")


@query("enrich", f"""
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'PENDING') AS status, 'USA' AS country, round(o_totalprice * 1.1, 4) AS gross,
           round(round(o_totalprice * 1.1, 4) / 12, 6) AS monthly, c_name AS o_custkey_lookup, TIMESTAMP '{RUN_TS}' AS _etl_timestamp, 'job-1' AS _etl_job_id
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey""")
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    names = load(spark, sf, "customer").where("c_acctbal >= 0")
    result = transforms.enrich(
        orders, {"status": "PENDING", "country": "USA"},
        {"gross": F.round(F.col("o_totalprice") * 1.1, 4), "monthly": F.round(F.col("gross") / 12, 6)},
        {"o_custkey": (names, "c_custkey", "c_name")}, RUN_TS, "job-1",
    )
    return result.select("o_orderkey", "status", "country", "gross", "monthly", "o_custkey_lookup", F.col("_etl_timestamp").cast("timestamp_ntz").alias("_etl_timestamp"), "_etl_job_id")


RULES = {
    "name": {"required": True, "pattern": r"Customer#\d+$"},
    "balance": {"type": "float", "min": 1000, "max": 9000},
    "state": {"type": "string", "enum": ["BUILDING", "MACHINERY", "FURNITURE"]},
    "c_custkey": {"type": "string"},
}
_ERRORS = """list_filter([CASE WHEN name IS NULL THEN 'name is required' WHEN NOT regexp_matches(name, '^Customer#\\d+$') THEN 'name does not match pattern Customer#\\d+$' END,
    CASE WHEN balance < 1000 THEN 'balance must be >= 1000' END, CASE WHEN balance > 9000 THEN 'balance must be <= 9000' END,
    CASE WHEN state NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'state must be one of [''BUILDING'', ''MACHINERY'', ''FURNITURE'']' END,
    'c_custkey must be a string'], lambda x: x IS NOT NULL)"""


@query("validate_tag", DIRTY + f"""SELECT c_custkey, array_to_string({_ERRORS}, '; ') AS errors, len({_ERRORS}) = 0 AS _is_valid FROM ({CLEAN})""")
def validate_tag(spark: SparkSession, sf: str) -> DataFrame:
    tagged = transforms.validate(_cleansed(dirty_customers(spark, sf)), RULES)
    return tagged.select("c_custkey", F.array_join("_validation_errors", "; ").alias("errors"), "_is_valid")


@query("validate_reject", DIRTY + f"""
    SELECT c_custkey, name, balance, true AS _is_valid FROM ({CLEAN})
    WHERE name IS NOT NULL AND (balance IS NULL OR balance BETWEEN 1000 AND 9000) AND state IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def validate_reject(spark: SparkSession, sf: str) -> DataFrame:
    rules = {k: v for k, v in RULES.items() if k != "c_custkey"}
    return transforms.validate(_cleansed(dirty_customers(spark, sf)), rules, reject_invalid=True).select("c_custkey", "name", "balance", "_is_valid")


@query("mask_pii", DIRTY + """
    SELECT c_custkey, '***-***-' || right(phone, 4) AS phone, '[REDACTED]' AS state, CAST(NULL AS VARCHAR) AS name, sha256(name) AS name_hash,
           CASE WHEN len(string_split(email, '@')) = 2 THEN left(email, 2) || '***@' || split_part(email, '@', 2) ELSE '***' END AS email,
           '***-**-' || right(balance, 4) AS balance, '****-****-****-' || right(since, 4) AS since
    FROM dirty""")
def mask_pii(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"email": "email", "phone": "phone", "balance": "ssn", "since": "credit_card", "absent": "email"}
    return transforms.mask_pii(dirty_customers(spark, sf), ["name"], kinds, ["state"])


@query("typecast", DIRTY + """
    SELECT c_custkey, CAST(trunc(TRY_CAST(balance AS DOUBLE)) AS BIGINT) AS balance, CAST(c_custkey AS VARCHAR) AS key_text, CAST(since_iso AS DATE) AS since_iso, flag IN ('building') AS flag
    FROM (SELECT *, CASE WHEN since LIKE '%x' THEN NULL ELSE '1999-03-' || left(since, 2) END AS since_iso, state AS flag FROM dirty)""")
def typecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = dirty_customers(spark, sf).select(
        "c_custkey", "balance", F.col("c_custkey").alias("key_text"),
        F.when(F.col("since").endswith("x"), F.col("since")).otherwise(F.concat(F.lit("1999-03-"), F.left("since", F.lit(2)))).alias("since_iso"),
        F.when(F.col("state") == "building", "YES").otherwise("no").alias("flag"),
    )
    return transforms.typecast(rows, {"balance": "int", "key_text": "string", "since_iso": "date", "flag": "bool", "absent": "int"})


@query("chain", DIRTY + f"""
    SELECT c_custkey, CAST(NULL AS VARCHAR) AS name, sha256(name) AS name_hash, state, 'USA' AS country, name || ' / ' || state AS label,
           CASE WHEN len(string_split(email, '@')) = 2 THEN left(email, 2) || '***@' || split_part(email, '@', 2) ELSE '***' END AS email
    FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY c_custkey) AS rn FROM ({CLEAN})) WHERE rn = 1""")
def chain(spark: SparkSession, sf: str) -> DataFrame:
    """Cleanse, enrich, de-duplicate and mask: each step works on the result of the step before."""
    rows = dirty_customers(spark, sf)
    return (
        rows.unionByName(rows)
        .transform(_cleansed)
        .transform(transforms.enrich, {"country": "USA"}, {"label": F.concat_ws(" / ", "name", "state")})
        .withColumn("label", F.when(F.col("name").isNotNull(), F.col("label")))
        .transform(dedup.deduplicate, ["email"], ["c_custkey"])
        .transform(transforms.mask_pii, ["name"], {"email": "email"})
        .select("c_custkey", "name", "name_hash", "state", "country", "label", "email")
    )


@query("audit_lineage", f"""
    SELECT s_suppkey, TIMESTAMP '{RUN_TS}' AS created_at, 'loader' AS created_by, false AS is_deleted, 1 AS version, 'erp' AS source_system, 'job-1' AS etl_job_id,
           TIMESTAMP '{RUN_TS}' AS ingestion_timestamp
    FROM supplier""")
def audit_lineage(spark: SparkSession, sf: str) -> DataFrame:
    stamped = transforms.add_lineage(transforms.add_audit(load(spark, sf, "supplier"), RUN_TS, "loader"), "erp", "job-1", RUN_TS)
    return stamped.select(
        "s_suppkey", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "created_by", "is_deleted", "version", "source_system", "etl_job_id",
        F.col("ingestion_timestamp").cast("timestamp_ntz").alias("ingestion_timestamp"))


@query("soft_delete", f"""
    SELECT c_custkey, c_acctbal >= 0 AS is_active, c_acctbal < 0 AS is_deleted, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{RUN_TS}' END AS deleted_at,
           CASE WHEN c_acctbal < 0 THEN 'admin' END AS deleted_by
    FROM customer""")
def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    marked = transforms.soft_delete(load(spark, sf, "customer"), F.col("c_acctbal") < 0, RUN_TS, "admin")
    return marked.select("c_custkey", "is_active", "is_deleted", F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"), "deleted_by")


@query("rename_project", "SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders")
def rename_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").withColumn("_row_note", F.lit("internal"))
    named = transforms.drop_internal(transforms.rename(rows, {"o_orderkey": "order_id", "o_totalprice": "amount", "absent": "x"}))
    return transforms.project_to(named, ["order_id", "amount", "other"])


@query("matched_rows", """
    SELECT c_custkey, true AS has_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def matched_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Existence check as an upsert does it: keys that the target has and keys that it has not."""
    customers = load(spark, sf, "customer").select("c_custkey")
    large = load(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.existing(customers, large, ["c_custkey"]).withColumn("has_orders", F.lit(True)).unionByName(
        joins.missing(customers, large, ["c_custkey"]).withColumn("has_orders", F.lit(False)))


@query("chain_counts", DIRTY + f""", c AS ({CLEAN}), v AS (SELECT * FROM c WHERE name IS NOT NULL AND balance IS NOT NULL)
    SELECT 'extracted' AS step, count(*) * 2 AS rows FROM dirty UNION ALL SELECT 'cleanse', count(*) * 2 FROM c UNION ALL SELECT 'require', count(*) * 2 FROM v
    UNION ALL SELECT 'dedup', count(*) FROM v UNION ALL SELECT 'mask', count(*) FROM v UNION ALL SELECT 'loaded', count(*) FROM v""")
def chain_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that leave each step of a chain, observed while the result is written."""
    rows, path = dirty_customers(spark, sf), scratch_path(spark, "chain")
    counts = chains.run_chain(rows.unionByName(rows), [
        ("cleanse", _cleansed), ("require", lambda d: d.dropna(subset=["name", "balance"])),
        ("dedup", lambda d: dedup.deduplicate(d, ["c_custkey"])), ("mask", lambda d: transforms.mask_pii(d, ["name"], {"email": "email"})),
    ], lambda d: d.write.parquet(path))
    return chains.counts_frame(rows, counts)
