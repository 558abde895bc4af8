"""Windows and running totals in keyed state with timers and expiry.

Every task adds its own rows up first, so a key, or a window of a key, sends one row per task to its state, however
busy it is. State is one small value for each key and open window, in RocksDB, and that of a window is freed by a timer; the results
are appended, and nothing that is finished is written again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strata.functions._cols import quoted
from strata.session import STATE_STORE
from strata.streaming.windows import MAX_AGE_SECONDS, WINDOW_SECONDS

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def _added_up(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key of each batch of a task, under the same names; nothing is shuffled."""
    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby(list(keys), dropna=False, sort=False, as_index=False)[list(sums)].sum()

    return rows.mapInPandas(add, rows.schema)


class _WindowState(StatefulProcessor):
    """State of one key and window: count and sum, until the watermark passes the end."""

    def __init__(self, size_seconds: int) -> None:
        self.size = size_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getValueState("parts", "n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        name, start = key
        n = total = 0
        for row in rows:
            n, total = n + row.n, total + row.total
        old = self.parts.get() if self.parts.exists() else None
        end = None if start is None else (start + self.size) * 1000
        if old is None and (end is None or end <= timerValues.getCurrentWatermarkInMs()):
            yield Row(key=name, start=start, n=n, total=float(total), late=True)
            return
        if old is None:
            self.handle.registerTimer(end)
        self.parts.update((n + (old[0] if old else 0), float(total + (old[1] if old else 0))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, total = self.parts.get()
        self.parts.clear()
        yield Row(key=key[0], start=key[1], n=n, total=total, late=False)

    def close(self) -> None: ...


def window_state(df: DataFrame, key: str, value: str, timestamp: str, size_seconds: int = WINDOW_SECONDS, max_age_seconds: int = MAX_AGE_SECONDS) -> DataFrame:
    """Tumbling windows of a stream, each emitted once: when an event has come ``max_age_seconds`` after its end.

    ``key, window_start, window_end, count, sum, avg, late``. Rows that come after their window was emitted are not
    dropped: each batch adds them up to a row of that window with ``late`` true, so windows and late rows together hold
    every row of a closed window; :func:`strata.streaming.windows.merged` adds them up. Rows without a
    time are late rows without a window. Values that are no numbers count, and add nothing to the sum.
    A batch closes windows by the events of the batches before it,
    after it has taken its own rows. Windows that no later event closes stay in the state for the next run from the same checkpoint.
    """
    df.sparkSession.conf.set(STORE_CONF, STATE_STORE)  # timers need it
    timed = df.withColumn("__ts", F.col(quoted(timestamp)).cast("timestamp")).withWatermark("__ts", f"{max_age_seconds} seconds")
    start = F.floor(F.unix_micros("__ts") / (size_seconds * 1_000_000)) * size_seconds
    number = F.coalesce(F.col(quoted(value)).try_cast("double"), F.lit(0.0))
    # the start is text on the way through pandas, which has no whole number without a value
    parts = timed.select(F.col(quoted(key)).alias("key"), start.cast("string").alias("start"), F.lit(1).cast("long").alias("n"), number.alias("total"))
    keyed = _added_up(parts, ["key", "start"], ["n", "total"]).withColumn("start", F.col("start").cast("long"))
    out = T.StructType([keyed.schema["key"], keyed.schema["start"], T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("late", T.BooleanType())])
    found = keyed.groupBy("key", "start").transformWithState(_WindowState(size_seconds), out, "Append", "EventTime")
    times = [F.timestamp_seconds(F.col("start") + shift).alias(name) for name, shift in (("window_start", 0), ("window_end", size_seconds))]
    return found.select("key", *times, F.col("n").alias("count"), F.col("total").alias("sum"), (F.col("total") / F.col("n")).alias("avg"), "late")


class _Totals(StatefulProcessor):
    """State of one key: its sums so far."""

    def __init__(self, keys: Sequence[str], sums: Sequence[str], state: str) -> None:
        self.keys, self.sums, self.schema = list(keys), list(sums), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sums = list(self.state.get()) if self.state.exists() else [0] * len(self.sums)
        for row in rows:
            sums = [a + row[name] for a, name in zip(sums, self.sums)]
        self.state.update(tuple(sums))
        yield Row(**dict(zip(self.keys, key)), **dict(zip(self.sums, sums)))

    def close(self) -> None: ...


def running_totals(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Totals since the start of the stream per key, emitted only for the keys that a batch touches.

    ``sums`` names what is added up; null adds nothing. Whole numbers stay whole, all other numbers are
    doubles. The state holds one small row for each key of the stream.
    The last row of each key (:func:`strata.streaming.runner.latest`) is its total.
    """
    df.sparkSession.conf.set(STORE_CONF, STATE_STORE)
    kinds = {n: "long" if isinstance(df.select(c).schema[0].dataType, (T.IntegralType, T.BooleanType)) else "double" for n, c in sums.items()}
    parts = df.select(*[F.col(quoted(k)) for k in keys], *[F.coalesce(c.cast(kinds[n]), F.lit(0).cast(kinds[n])).alias(n) for n, c in sums.items()])
    added = _added_up(parts, keys, list(sums))
    state = ", ".join(f"{quoted(n)} {kind}" for n, kind in kinds.items())
    return added.groupBy(*[F.col(quoted(k)) for k in keys]).transformWithState(
        _Totals(keys, list(sums), state), added.schema, "Update", "None")
