"""Loads by key against sets of keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.session import scratch_path
from strata.sources import known_keys


def test_loads_bring_unknown_keys_only(spark, monkeypatch):
    rng = random.Random(5)
    for pages in (known_keys.PAGES, 1):
        monkeypatch.setattr(known_keys, "PAGES", pages)
        path, known = scratch_path(spark, "known"), set()
        for _ in range(4):
            rows = [(rng.choice([None, *range(120)]), rng.choice(["x", "y", None]), rng.random()) for _ in range(150)]
            rows += rows[:5]
            got = []
            known_keys.load_new_keys(spark.createDataFrame(rows, "`a.b` long, k string, v double"), ["a.b", "k"], path, lambda df: got.extend(tuple(r) for r in df.collect()))
            assert sorted(got, key=str) == sorted((r for r in rows if r[:2] not in known), key=str)
            known |= {r[:2] for r in rows}
        got = []
        known_keys.load_new_keys(spark.createDataFrame([], "`a.b` long, k string, v double"), ["a.b", "k"], path, lambda df: got.extend(df.collect()))
        assert not got and known_keys.loads(spark, path) == 5


def test_filter_lets_new_rows_pass_and_misses_no_known_one(spark):
    path = scratch_path(spark, "filter")
    known_keys.load_new_keys(spark.range(3000), ["id"], path, lambda df: None)
    new, maybe = known_keys.split_new(spark.range(1000, 9000), ["id"], path, 1)
    assert maybe.where(F.col("id") < 3000).count() == 2000 and new.count() >= 5990
    assert new.count() + maybe.count() == 8000


def test_failed_load_is_repeated(spark):
    path, got = scratch_path(spark, "failed"), []

    def fail(df):
        raise RuntimeError

    for sink in (fail, lambda df: got.append(df.count())):
        try:
            known_keys.load_new_keys(spark.range(10), ["id"], path, sink)
        except RuntimeError:
            assert known_keys.loads(spark, path) == 0
    assert got == [10]
