from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from strata.quality import profile, sketches
from strata.session import scratch_path
from tests.conftest import rows

EXACT = ["column_name", "data_type", "total_count", "null_count", "null_rate", "completeness", "min_value", "max_value", "mean_value", "std_dev", "min_length", "max_length", "avg_length"]


def table(spark, n=3000):
    rng = random.Random(5)
    data = [(i, rng.gauss(1e6, 3.0), rng.choice(["x", "yy", None]), f"2024-01-{i % 28 + 1:02d}", None, rng.random() < 0.5) for i in range(n)]
    return spark.createDataFrame(data, "`the id` int, v double, t string, `d.ay` string, nothing double, flag boolean"), data


def test_profile_of_parts_equals_that_of_the_whole(spark):
    df, data = table(spark)
    parts = [df.where(F.col("the id") % 5 == k) for k in range(5)] + [df.where("false")]
    store = scratch_path(spark, "states")
    assert sketches.stored(spark, store).count() == 0
    for i, part in enumerate(parts):
        sketches.save(sketches.state(part), store, f"l{i}")
    sketches.save(sketches.state(parts[0]), store, "l0")  # a load that is repeated
    got, want = sketches.profile(sketches.stored(spark, store)), profile.profile_columns(df)
    assert got.columns == want.columns
    assert rows(got.select(EXACT)) == rows(want.select(EXACT))
    unique = {r[0]: (r[1], r[2]) for r in got.select("column_name", "unique_count", "median_value").collect()}
    for r in want.collect():
        assert abs(unique[r["column_name"]][0] - r["unique_count"]) <= 0.05 * r["unique_count"], r["column_name"]
    values = sorted(x[1] for x in data)
    rank = sum(v <= unique["v"][1] for v in values) / len(values)
    assert abs(rank - 0.5) < 0.03 and abs(unique["the id"][1] - statistics.median(range(3000))) < 0.03 * 3000
    assert sketches.trend(sketches.stored(spark, store)).where("total_count = 600 AND column_name = 'v'").count() == 5


def test_drift_of_states_and_mixed_kinds(spark):
    df, _ = table(spark, 100)
    before, after = sketches.state(df.drop("flag")), sketches.state(df.withColumn("v", F.when(F.col("the id") < 50, F.col("v"))))
    change = {r["column_name"]: r["change"] for r in profile.drift(sketches.profile(before), sketches.profile(after)).collect()}
    assert change == {"flag": "added", "v": "modified"}
    mixed = sketches.state(df.select(F.lit("a").alias("v"))).unionByName(sketches.state(df.select("v")))
    assert [tuple(r) for r in sketches.profile(mixed).select("data_type", "total_count").collect()] == [("mixed", 200)]
    assert [r["total_count"] for r in sketches.profile(sketches.state(df.where("false"))).collect()] == [0] * 6
