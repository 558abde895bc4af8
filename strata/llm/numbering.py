"""Numbers and running totals inside groups of any size, without one task that holds a group.

A group is cut into up to ``CUTS`` cuts by a hash of the row; each cut is ordered by itself, and the cuts'
totals are added up in a table of at most ``CUTS`` rows a group. A group with a third of all rows is so
spread over ``CUTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 4096


def running(df: DataFrame, group: list[str], place: Column, order: list[Column], amount: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` (default 1) over the earlier rows of the group, as a long in ``name``.

    ``place`` is a hash of the row as a long; its upper bits give the cut, so the order is that of the
    cuts, then of ``order`` inside a cut. Rows that are equal in ``order`` are interchangeable.
    """
    keyed = df.withColumns({"__cut": F.shiftrightunsigned(place, 52), "__amount": F.lit(1).cast("long") if amount is None else amount.cast("long")})
    totals = keyed.groupBy(*group, "__cut").agg(F.sum("__amount").alias("__total"))
    earlier = Window.partitionBy(*group).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cut").alias("__c"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    condition = F.col("__cut") == F.col("__c")
    for s in same:
        condition = condition & s
    out = keyed.withColumn("__inside", F.coalesce(F.sum("__amount").over(inside), F.lit(0))).join(offsets, condition)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__offset") + F.col("__inside")).alias(name))
