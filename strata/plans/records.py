"""Keyed records: customers as students, suppliers as advisors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import records
from strata.plans.registry import query
from strata.tables import load, view, with_views

_STUDENTS = with_views("advised")
_BOTH = with_views("advised", "advisors")


def _urgent(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")


_URGENT = "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000"


@query("insert_records", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def insert_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.insert(view(spark, sf, "advised").select("id", "name"), view(spark, sf, "advisors").select("id", "name"))


@query("find_by_id", _STUDENTS + f" SELECT id, name, gpa, advisor FROM advised WHERE id IN ({_URGENT})")
def find_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return records.find_all(view(spark, sf, "advised"), "id", _urgent(spark, sf), "o_custkey")


@query("contains_ids", "SELECT DISTINCT l_suppkey, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AS is_present FROM lineitem")
def contains_ids(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = load(spark, sf, "supplier").where("s_acctbal > 5000")
    return records.contains(suppliers, "s_suppkey", load(spark, sf, "lineitem"), "l_suppkey")


@query("delete_by_id", _STUDENTS + f" SELECT id, name, gpa, advisor FROM advised WHERE id NOT IN ({_URGENT})")
def delete_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return records.delete(view(spark, sf, "advised"), "id", _urgent(spark, sf), "o_custkey")


@query("ordered_records", _BOTH + " SELECT id, name, department FROM advisors ORDER BY id")
def ordered_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.ordered(view(spark, sf, "advisors"), "id")


@query("min_max_record", """
    SELECT 'min' AS which, o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)
    UNION ALL SELECT 'max', o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def min_max_record(spark: SparkSession, sf: str) -> DataFrame:
    return records.ends(load(spark, sf, "orders"), "o_orderkey", ["o_totalprice"])


@query("record_summary", "SELECT count(*) AS records, min(o_custkey) AS min_id, max(o_custkey) AS max_id, median(o_custkey) AS median_id FROM orders")
def record_summary(spark: SparkSession, sf: str) -> DataFrame:
    return records.summary(load(spark, sf, "orders"), "o_custkey")


@query("advisor_join", _BOTH + " SELECT s.id, s.name, s.gpa, s.advisor, a.id AS advisor_id, a.name AS advisor_name, a.department AS advisor_department FROM advised s LEFT JOIN advisors a ON s.advisor = a.id")
def advisor_join(spark: SparkSession, sf: str) -> DataFrame:
    return records.with_advisor(view(spark, sf, "advised"), view(spark, sf, "advisors"))


@query("advisee_links", _STUDENTS + " SELECT advisor, id AS advisee FROM advised")
def advisee_links(spark: SparkSession, sf: str) -> DataFrame:
    return records.advisee_links(view(spark, sf, "advised"))


@query("advisee_lists", _STUDENTS + f"""
    SELECT advisor, place // {records.PAGE_SIZE} + 1 AS page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS advisees
    FROM (SELECT advisor, id, row_number() OVER (PARTITION BY advisor ORDER BY id) - 1 AS place FROM advised) GROUP BY ALL""")
def advisee_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = records.advisee_lists(view(spark, sf, "advised"), hot_rows=50)
    return lists.withColumn("advisees", F.array_join(F.col("advisees").cast("array<string>"), ","))


@query("reassign_advisor", _STUDENTS + """
    SELECT id, name, CASE WHEN gpa < 0 THEN NULL WHEN gpa > 9000 THEN 1 ELSE advisor END AS advisor FROM advised""")
def reassign_advisor(spark: SparkSession, sf: str) -> DataFrame:
    students = view(spark, sf, "advised")
    changes = students.where("gpa < 0 OR gpa > 9000").select("id", F.when(F.col("gpa") > 9000, F.lit(1).cast("bigint")).alias("advisor"))
    return records.reassign(students, changes).select("id", "name", "advisor")
