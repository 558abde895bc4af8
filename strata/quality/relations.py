"""Declared foreign keys as data, and one audit of all of them.

The keys of all children and parents go into one shuffle, each tagged with its relation and counted in the map
tasks, so a key with a third of a child's rows is one row for each task, and twenty relations cost what one does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions._cols import named


@dataclass(frozen=True)
class Relation:
    child: str
    column: str
    parent: str
    key: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}"


#: Declared relations between the tables of the four domains: fixed values.
RELATIONS = (
    Relation("encounters", "patient_id", "patients", "patient_id"),
    Relation("encounters", "provider_id", "providers", "provider_id"),
    Relation("lab_results", "patient_id", "patients", "patient_id"),
    Relation("diagnoses", "patient_id", "patients", "patient_id"),
    Relation("medications", "patient_id", "patients", "patient_id"),
    Relation("transactions", "account_id", "accounts", "account_number"),
    Relation("investments", "account_id", "accounts", "account_number"),
    Relation("metrics", "server_id", "servers", "server_id"),
    Relation("incidents", "server_id", "servers", "server_id"),
    Relation("applications", "server_id", "servers", "server_id"),
    Relation("deployments", "app_id", "applications", "app_id"),
    Relation("endpoints", "app_id", "applications", "app_id"),
    Relation("students", "department_id", "departments", "department_id"),
    Relation("faculty", "department_id", "departments", "department_id"),
    Relation("courses", "department_id", "departments", "department_id"),
    Relation("courses", "instructor_id", "faculty", "faculty_id"),
    Relation("enrollments", "course_id", "courses", "course_id"),
    Relation("enrollments", "student_id", "students", "student_id"),
    Relation("research_grants", "principal_investigator_id", "faculty", "faculty_id"),
)


def present(relations: Iterable[Relation], columns: dict[str, list[str]]) -> list[Relation]:
    """The relations whose tables and columns are there."""
    return [r for r in relations if r.column in columns.get(r.child, ()) and r.key in columns.get(r.parent, ())]


def audit(tables: Callable[[str], DataFrame], relations: Iterable[Relation]) -> DataFrame:
    """``relation, child, parent, children, nulls, orphans, orphan_keys, parents`` for each relation.

    Children with a null key are counted and are no orphans. Keys are compared as text. A parent's repeated key
    counts once. ``parents`` counts different keys. An empty child or parent has zeros.
    """
    relations = list(relations)
    if not relations:
        raise ValueError("no relations to audit")
    zero = F.lit(0).cast("long")
    parts = []
    for i, r in enumerate(relations):
        tag = F.lit(i).alias("relation")
        parts.append(tables(r.child).select(tag, named(r.column).cast("string").alias("key"), F.lit(1).cast("long").alias("children"), zero.alias("parent")))
        parts.append(tables(r.parent).where(named(r.key).isNotNull()).select(tag, named(r.key).cast("string").alias("key"), zero.alias("children"), F.lit(1).cast("long").alias("parent")))
    keys = reduce(DataFrame.unionByName, parts).groupBy("relation", "key").agg(F.sum("children").alias("children"), F.max("parent").alias("parent"))
    orphan = F.col("key").isNotNull() & (F.col("parent") == 0)
    sums = keys.groupBy("relation").agg(
        F.sum("children").alias("children"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("children"))), zero).alias("nulls"),
        F.coalesce(F.sum(F.when(orphan, F.col("children"))), zero).alias("orphans"), F.count_if(orphan).alias("orphan_keys"), F.sum("parent").alias("parents"))
    names = df_of(sums, relations)
    filled = names.join(sums, "relation", "left")
    return filled.select("name", "child_table", "parent_table", *[F.coalesce(c, zero).alias(c) for c in ("children", "nulls", "orphans", "orphan_keys", "parents")]).withColumnsRenamed({"name": "relation", "child_table": "child", "parent_table": "parent"})


def df_of(like: DataFrame, relations: list[Relation]) -> DataFrame:
    """The relations as rows, numbered in order."""
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("relation"), F.lit(r.name).alias("name"), F.lit(r.child).alias("child_table"), F.lit(r.parent).alias("parent_table")) for i, r in enumerate(relations)]))
    return like.sparkSession.range(1).select(rows.alias("r")).select("r.*")
