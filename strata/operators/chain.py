"""Run a chain of steps into a sink and report how many rows left each step."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def run_chain(df: DataFrame, steps: Sequence[Step], sink: Callable[[DataFrame], None]) -> dict[str, int]:
    """Rows extracted, rows after each step, rows loaded; every step works on the result of the one before.

    The numbers come from observed metrics of the one job that loads the rows, so they cost no extra
    pass. They are meant for monitoring: a stage that Spark has to repeat may be counted twice. Filters
    are not moved across an observed step, so keep filters that should reach the scan before the chain.
    An empty result loads no rows.
    """
    watched: list[tuple[str, Observation]] = []

    def watch(rows: DataFrame, name: str) -> DataFrame:
        seen = Observation(name)
        watched.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"))

    current = watch(df, "extracted")
    for name, step in steps:
        current = watch(step(current), name)
    sink(current)
    counts = {name: int(seen.get["rows"]) for name, seen in watched}
    counts["loaded"] = counts[watched[-1][0]]
    return counts


def counts_frame(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """The numbers as rows (step, rows)."""
    return df.sparkSession.createDataFrame(list(counts.items()), "step string, rows bigint")
