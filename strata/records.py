"""Operations on a table of records keyed by an integer id, and the student–advisor relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.quantiles import exact_median
from strata.operators.windows import HOT_ROWS, window

# Advisees on one page of an advisor's list.
PAGE_SIZE = 100


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append; ids may repeat."""
    return table.unionByName(rows)


def find(table: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with an id; the condition is pushed into the scan."""
    return table.where(F.col(key) == F.lit(value))


def find_all(table: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    keys = wanted.select(F.col(wanted_key).alias("__wanted"))
    return table.join(keys, F.col(key) == F.col("__wanted"), "left_semi")


def contains(table: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """(wanted key, is_present) for a list of ids, which is taken to be distinct."""
    ids = table.select(F.col(key).alias("__id")).distinct()
    asked = wanted.select(wanted_key).distinct()
    return asked.join(ids, F.col(wanted_key) == F.col("__id"), "left").select(wanted_key, F.col("__id").isNotNull().alias("is_present"))


def delete(table: DataFrame, key: str, doomed: DataFrame, doomed_key: str) -> DataFrame:
    keys = doomed.select(F.col(doomed_key).alias("__doomed"))
    return table.join(keys, F.col(key) == F.col("__doomed"), "left_anti")


def ordered(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(key)


def ends(table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Two rows: the record with the lowest and the one with the highest id."""
    row = F.struct(key, *columns)
    picked = table.agg(F.min_by(row, key).alias("min"), F.max_by(row, key).alias("max"))
    return picked.select(F.explode(F.map_from_arrays(F.array(F.lit("min"), F.lit("max")), F.array("min", "max"))).alias("which", "r")).select("which", "r.*")


def summary(table: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """Number of records and lowest, median and highest id."""
    counts = table.agg(F.count(F.lit(1)).alias("records"), F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.lit(1).alias("__one"))
    middle = exact_median(table, [], key, "median_id", **({} if hot_rows is None else {"hot_rows": hot_rows}))
    return counts.join(middle.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def with_advisor(students: DataFrame, faculty: DataFrame, advisor: str = "advisor", faculty_id: str = "id", prefix: str = "advisor_") -> DataFrame:
    """Students with their advisor's columns; an advisor who does not exist gives nulls."""
    named = faculty.select(*[F.col(c).alias(f"{prefix}{c}") for c in faculty.columns])
    return students.join(named, F.col(advisor) == F.col(f"{prefix}{faculty_id}"), "left")


def advisee_links(students: DataFrame, advisor: str = "advisor", student_id: str = "id") -> DataFrame:
    """The relation as rows (advisor, advisee), without any limit."""
    return students.where(F.col(advisor).isNotNull()).select(F.col(advisor).alias("advisor"), F.col(student_id).alias("advisee"))


def advisee_lists(students: DataFrame, advisor: str = "advisor", student_id: str = "id", page_size: int = PAGE_SIZE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every advisee of every advisor as numbered pages: (advisor, page, advisees), ids in order.

    The pages of an advisor together hold all advisees; a page has a fixed size, so no row grows with the
    group, and the places come from the segmented window, so an advisor with very many is split.
    """
    links = advisee_links(students, advisor, student_id)
    placed = window(links, ["advisor"], ["advisee"], {"place": {"function": "row_number"}}, [], hot_rows)
    paged = placed.withColumn("page", F.floor((F.col("place") - 1) / page_size) + 1)
    return paged.groupBy("advisor", "page").agg(F.sort_array(F.collect_list("advisee")).alias("advisees"))


def reassign(students: DataFrame, changes: DataFrame, student_id: str = "id", advisor: str = "advisor") -> DataFrame:
    """Set new advisors from a (student, advisor) table; a null advisor removes the link."""
    new = changes.select(F.col(student_id).alias("__student"), F.col(advisor).alias("__advisor"), F.lit(True).alias("__set"))
    joined = students.join(new, F.col(student_id) == F.col("__student"), "left")
    value = F.when(F.coalesce(F.col("__set"), F.lit(False)), F.col("__advisor")).otherwise(F.col(advisor))
    return joined.withColumn(advisor, value).drop("__student", "__advisor", "__set")
