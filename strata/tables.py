"""The given tables, and the views of them that stand in for the tables of the four domains.

A view is a list of expressions that mean the same in Spark SQL and in plain SQL, so the two sides of
a check start from the same rows. Where the dialects differ, a pair (Spark, other) is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str | tuple[str, str]]
    joins: tuple[tuple[str, str, str], ...] = ()
    where: str | None = None


_K = ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
_NATION = (("nation", "c_nationkey", "n_nationkey"),)

VIEWS: dict[str, View] = {
    "accounts": View("customer", {
        "account_number": "c_custkey", "customer_id": "c_custkey", "customer_name": "c_name", "customer_type": "c_mktsegment",
        "account_type": "c_mktsegment", "current_balance": "c_acctbal", "aml_risk_score": "c_custkey % 101",
        "status": "CASE WHEN c_acctbal < 0 THEN 'FROZEN' ELSE 'ACTIVE' END",
    }),
    "transactions": View("orders", {
        "transaction_id": "o_orderkey", "account_id": "o_custkey",
        "amount": "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END",
        "transaction_type": "CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END",
        "transaction_date": "o_orderdate", "merchant_name": "nullif(concat('Shop ', o_orderpriority), 'Shop 5-LOW')",
        "merchant_category": "o_orderpriority", "is_flagged": "o_orderpriority = '1-URGENT'", "fraud_score": "o_orderkey % 101",
    }),
    "loan_applications": View("orders", {
        "application_id": "o_orderkey",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'DENIED' ELSE 'SUBMITTED' END",
        "requested_amount": "o_totalprice",
    }),
    "patients": View("customer", {
        "patient_id": "c_custkey", "first_name": "split_part(c_name, '#', 1)", "last_name": "split_part(c_name, '#', 2)",
        "date_of_birth": ("date_add(DATE '1940-01-01', CAST(c_custkey * 37 % 25000 AS INT))", "DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER)"),
        "gender": "nullif(c_mktsegment, 'MACHINERY')", "city": "c_mktsegment", "state": "n_name", "is_deceased": "c_acctbal < 0",
    }, _NATION),
    "encounters": View("orders", {
        "encounter_id": "o_orderkey", "patient_id": "o_custkey", "provider_id": "o_orderkey % 200", "encounter_type": "o_orderpriority",
        "encounter_date": "o_orderdate", "total_charges": "o_totalprice",
    }),
    "lab_results": View("lineitem", {
        "patient_id": "l_orderkey", "test_code": "l_linestatus", "value": "l_quantity", "abnormal_flag": "l_returnflag = 'R'",
        "critical_flag": "l_returnflag = 'R' AND l_linestatus = 'F'",
    }),
    "providers": View("supplier", {"provider_id": "s_suppkey", "first_name": "split_part(s_name, '#', 1)", "last_name": "split_part(s_name, '#', 2)"}),
    "servers": View("supplier", {
        "server_id": "s_suppkey", "hostname": "lower(s_name)", "status": "CASE WHEN s_acctbal < 500 THEN 'STOPPED' ELSE 'RUNNING' END",
        "environment": "r_name", "datacenter": "n_name",
    }, (("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"))),
    "metrics": View("events", {
        "metric_id": "event_id", "server_id": "user_id", "timestamp": "ts", "cpu_usage_pct": "least(value, 100)", "memory_used_pct": _K,
    }),
    "incidents": View("events", {
        "incident_id": "event_id", "server_id": "user_id", "severity": "concat('SEV', CAST(event_id % 4 + 1 AS STRING))",
        "reported_at": "ts", "status": "CASE WHEN value < 20 THEN 'RESOLVED' WHEN value < 40 THEN 'CLOSED' ELSE 'OPEN' END",
        "time_to_resolve_minutes": (f"CASE WHEN value < 40 THEN {_K[0]} END", f"CASE WHEN value < 40 THEN {_K[1]} END"),
    }, where="event_type = 'error'"),
    "deployments": View("lineitem", {
        "deployment_id": "l_orderkey", "status": "CASE WHEN l_linestatus = 'F' THEN 'SUCCESS' ELSE 'FAILED' END",
        "duration_seconds": "CASE WHEN l_returnflag <> 'N' THEN l_quantity * 60 END",
    }),
    "applications": View("part", {"app_id": "p_partkey", "app_name": "p_name", "app_type": "p_type", "language": "p_brand"}),
    "students": View("customer", {
        "student_id": "c_custkey", "first_name": "split_part(c_name, '#', 1)", "last_name": "split_part(c_name, '#', 2)",
        "gpa": "CAST((c_acctbal + 1000) / 2750 AS DECIMAL(5,2))", "major": "n_name",
        "enrollment_status": "CASE c_mktsegment WHEN 'BUILDING' THEN 'GRADUATED' WHEN 'MACHINERY' THEN 'WITHDRAWN' ELSE 'ACTIVE' END",
        "academic_level": "CASE WHEN c_acctbal < 2000 THEN 'FRESHMAN' WHEN c_acctbal < 5000 THEN 'JUNIOR' ELSE 'SENIOR' END",
    }, _NATION),
    "faculty": View("supplier", {
        "faculty_id": "s_suppkey", "first_name": "split_part(s_name, '#', 1)", "last_name": "split_part(s_name, '#', 2)", "department": "n_name",
        "rank": "CASE WHEN s_acctbal < 3000 THEN 'ASSISTANT' WHEN s_acctbal < 6000 THEN 'ASSOCIATE' ELSE 'PROFESSOR' END",
        "publications_count": "s_suppkey % 50",
    }, (("nation", "s_nationkey", "n_nationkey"),)),
    "courses": View("part", {
        "course_id": "p_partkey", "course_code": "concat('C', CAST(p_partkey AS STRING))", "title": "p_name", "department_id": "p_brand",
        "capacity": "nullif(p_size, 7)", "enrolled_count": "p_partkey % 40", "instructor_id": "p_partkey % 150",
        "term": "CASE WHEN p_size < 20 THEN 'FALL_2023' WHEN p_size < 40 THEN 'SPRING_2024' ELSE 'FALL_2024' END",
    }),
    "enrollments": View("lineitem", {
        "enrollment_id": "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING))",
        "student_id": "l_suppkey", "course_id": "l_partkey", "credits": "l_linenumber", "grade_points": "l_discount * 40",
        "grade": "CASE WHEN l_discount >= 0.08 THEN 'A' WHEN l_discount >= 0.05 THEN 'B' WHEN l_discount >= 0.02 THEN 'C' WHEN l_tax < 0.04 THEN 'F' END",
        "status": "CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'ENROLLED' END",
    }),
    "research_grants": View("part", {
        "grant_id": "p_partkey", "total_amount": "p_retailprice", "amount_spent": "p_retailprice * p_size / 100",
        "status": "CASE WHEN p_type = 'PROMO' THEN 'ACTIVE' ELSE 'CLOSED' END",
    }),
    "departments": View("nation", {"department_id": "n_nationkey", "name": "n_name"}),
    "advised": View("customer", {"id": "c_custkey", "name": "c_name", "gpa": "c_acctbal", "advisor": "c_custkey % 13"}),
    "advisors": View("supplier", {"id": "s_suppkey", "name": "s_name", "department": "s_nationkey"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a projection of the given tables."""
    spec = VIEWS[name]
    df = load(spark, sf_dir, spec.table)
    for table, left, right in spec.joins:
        df = df.join(load(spark, sf_dir, table), F.col(left) == F.col(right))
    if spec.where:
        df = df.where(spec.where)
    return df.select(*[F.expr(e if isinstance(e, str) else e[0]).alias(n) for n, e in spec.columns.items()])


def view_sql(name: str) -> str:
    spec = VIEWS[name]
    columns = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {n}" for n, e in spec.columns.items())
    joins = "".join(f" JOIN {t} ON {a} = {b}" for t, a, b in spec.joins)
    return f"SELECT {columns} FROM {spec.table}{joins}" + (f" WHERE {spec.where}" if spec.where else "")


def with_views(*names: str) -> str:
    """``WITH`` clause that defines domain tables for plain SQL."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
