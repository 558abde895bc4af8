from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from strata.operators import aggregate as agg
from strata.operators import chain
from strata.operators import dedup, joins, pivot, quantiles, transforms, windows
from tests.conftest import one, rows


@pytest.fixture(scope="module")
def sales(spark):
    data = [("a", "x", 1.0, 1), ("a", "x", None, 2), ("a", "y", 3.0, 3), ("b", None, 5.0, 4), (None, "x", 7.0, 5), ("c", "x", None, 6)]
    return spark.createDataFrame(data, "g string, p string, v double, o int")


def test_aggregate_defaults(sales):
    metrics = {f: {"column": "v", "function": f} for f in ("count", "count_distinct", "sum", "avg", "min", "max", "std", "first", "last")}
    got = {r["g"]: tuple(r)[1:] for r in agg.aggregate(sales, ["g"], metrics, order_by=["o"]).collect()}
    assert got["a"] == (3, 2, 4.0, 2.0, 1.0, 3.0, pytest.approx(2**0.5), 1.0, 3.0)
    assert got["c"] == (1, 0, 0.0, None, None, None, None, None, None)
    assert got[None][:3] == (1, 1, 7.0)


def test_aggregate_text_numbers(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "2"), ("b", "x"), ("b", "2")], "g string, v string")
    got = agg.aggregate(df, ["g"], {"s": {"column": "v", "function": "sum"}, "m": {"column": "v", "function": "avg"}})
    assert rows(got) == [("a", 3.5, 1.75), ("b", None, None)]


def test_aggregate_without_keys(sales):
    assert one(agg.aggregate(sales, [], {"n": {"function": "count"}})) == (6,)
    assert agg.aggregate(sales.where("false"), [], {"n": {"function": "count"}}).count() == 0


def test_aggregate_errors(sales):
    with pytest.raises(ValueError):
        agg.aggregate(sales, ["g"], {"x": {"column": "v", "function": "mode"}})
    with pytest.raises(ValueError):
        agg.aggregate(sales, ["g"], {"x": {"column": "v", "function": "first"}})


def test_aggregate_step(sales):
    spec = {f: {"column": "v", "function": f} for f in ("sum", "avg", "count", "min")}
    got = {r["g"]: tuple(r)[1:] for r in agg.aggregate_step(sales, ["g"], spec).collect()}
    assert got["a"] == (4.0, 2.0, 2, 1.0) and got["c"] == (0.0, 0.0, 0, None)
    assert agg.aggregate_step(sales, [], spec) is sales


def test_small_aggregates(spark, sales):
    assert rows(agg.distribution(sales, "p")) == [(None, 1), ("x", 4), ("y", 1)]
    assert rows(agg.distribution(sales, "absent")) == [("UNKNOWN", 6)]
    assert one(sales.agg(agg.share(F.col("v") > 2))) == (0.5,)
    assert one(sales.where("false").agg(agg.share(F.col("v") > 2))) == (0.0,)
    assert one(sales.where("o = 1").agg(agg.std_or_zero(F.col("v")))) == (0.0,)
    df = spark.createDataFrame([(4.0, 3), (2.0, None), (None, 1)], "p double, c int")
    assert one(df.agg(agg.weighted_mean(F.col("p"), F.col("c")))) == (pytest.approx(18 / 7),)
    df = spark.createDataFrame([(5, 10), (4, None), (3, 0)], "n int, cap int")
    assert one(df.agg(agg.mean_ratio(F.col("n"), F.col("cap")))) == (2.25,)


def test_pivot(sales):
    wide = pivot.pivot(sales, ["g"], "p", "v", "sum")
    assert wide.columns == ["g", "p_x", "p_y"]
    assert rows(wide) == [(None, 7.0, 0.0), ("a", 1.0, 3.0)]
    assert rows(pivot.pivot(sales, ["g"], "p", "v", "avg")) == [(None, 7.0, None), ("a", 1.0, 3.0)]
    assert rows(pivot.pivot(sales, ["g"], "p", "v", "count")) == [(None, 1, 0), ("a", 1, 1)]


def test_pivot_rows(sales):
    wide = pivot.pivot_rows(sales, "g", "p", "v", "avg")
    assert wide.columns == ["g", "p_x", "p_y", "p_None"]
    assert rows(wide) == [(None, 7.0, 0.0, 0.0), ("a", 0.5, 3.0, 0.0), ("b", 0.0, 0.0, 5.0), ("c", 0.0, 0.0, 0.0)]
    assert rows(pivot.pivot_rows(sales, "g", "p", "v", "count"))[1] == ("a", 2, 1, 0)


def test_unpivot(sales):
    tall = pivot.unpivot_columns(sales.where("o = 2").withColumn("w", F.lit(9.0)), ["o"], ["v", "w"])
    assert rows(tall) == [(2, "v", None), (2, "w", 9.0)]


METRICS = {
    "rn": {"function": "row_number"}, "rk": {"function": "rank"}, "lg": {"function": "lag", "column": "v", "window": 2},
    "ld": {"function": "lead", "column": "v", "window": 3}, "rs": {"function": "running_sum", "column": "v"}, "ra": {"function": "running_avg", "column": "v"},
}


def brute_windows(data):
    """data: (id, group, order, value) tuples."""
    out = {}
    for g in {r[1] for r in data}:
        part = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, r[2], r[0]))
        total, seen, rank = 0.0, 0, 1
        for i, r in enumerate(part):
            if i and part[i - 1][2] != r[2]:
                rank = i + 1
            if r[3] is not None:
                total, seen = total + r[3], seen + 1
            out[r[0]] = (
                i + 1, rank, part[i - 2][3] if i >= 2 else None, part[i + 3][3] if i + 3 < len(part) else None, total, total / seen if seen else None,
            )
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 7, 1])
@pytest.mark.parametrize("grouped", [True, False])
def test_windows_match_brute_force(spark, hot_rows, grouped):
    rng = random.Random(5)
    groups = ["hot", "hot", "hot", "cold", None] if grouped else ["all"]
    data = [(i, rng.choice(groups), rng.choice([None, 1, 2, 2, 3, 9]), rng.choice([None, 1.0, 2.0, 4.0])) for i in range(60)]
    df = spark.createDataFrame(data, "id int, g string, o int, v double")
    got = windows.window(df, ["g"] if grouped else [], "o", METRICS, tie_break=["id"], hot_rows=hot_rows)
    assert {r["id"]: tuple(r)[4:] for r in got.collect()} == brute_windows(data)


def test_windows_split_a_group_of_copies(spark):
    df = spark.createDataFrame([("k", 1)] * 40 + [("k", 2)], "g string, o int")
    got = windows.window(df, ["g"], "o", {"rn": {"function": "row_number"}, "rk": {"function": "rank"}}, hot_rows=5)
    assert sorted(r["rn"] for r in got.collect()) == list(range(1, 42))
    assert {(r["o"], r["rk"]) for r in got.collect()} == {(1, 1), (2, 41)}


def test_windows_refuse_unknown_functions(sales):
    with pytest.raises(ValueError):
        windows.window(sales, ["g"], "o", {"x": {"function": "ntile"}})


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_exact_median(spark, hot_rows):
    rng = random.Random(3)
    data = [(g, rng.choice([None, *range(30)])) for g in ("a", "b", None) for _ in range(51)]
    df = spark.createDataFrame(data, "g string, v int")
    want = {g: statistics.median([v for k, v in data if k == g and v is not None]) for g in ("a", "b", None)}
    assert dict(rows(quantiles.exact_median(df, ["g"], "v", hot_rows=hot_rows))) == want
    whole = statistics.median([v for _, v in data if v is not None])
    assert one(quantiles.exact_median(df, [], "v", hot_rows=hot_rows)) == (whole,)


def test_dedup(spark):
    df = spark.createDataFrame([(1, "k", "a"), (2, "k", "b"), (3, None, "c"), (4, None, "d"), (5, "x" * 100, "e"), (6, "x" * 100, "f")], "o int, k string, v string")
    assert [r["o"] for r in dedup.deduplicate(df, ["k"], ["o"]).orderBy("o").collect()] == [1, 3, 5]
    assert [r["o"] for r in dedup.deduplicate(df, ["k"], ["o"], "last").orderBy("o").collect()] == [2, 4, 6]
    assert [r["o"] for r in dedup.deduplicate(df, ["k"], ["o"], "none").orderBy("o").collect()] == [1, 3, 5]
    assert dedup.deduplicate(df, [], ["o"]) is df
    with pytest.raises(ValueError):
        dedup.deduplicate(df, ["k"], ["o"], "middle")


def test_dedup_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS k")
    plan = dedup.deduplicate(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("Partial")
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < partial


def test_duplicate_summary(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "1"), (1, "a"), (1, "a"), (1, "a")], "a int, b string")
    assert one(dedup.duplicate_summary(df)) == (6, 3, 3)
    assert one(dedup.duplicate_summary(df.where("false"))) == (0, 0, 0)


def test_derived_dimension(spark):
    df = spark.createDataFrame([(2, "m", "x"), (1, "m", "y"), (3, None, "z"), (4, "", "q")], "o int, k string, c string")
    assert rows(dedup.derived_dimension(df, "k", ["c"], ["o"])) == [("m", "y")]


def test_lookup_and_join(spark):
    facts = spark.createDataFrame([(1, "a"), (2, None), (3, "zz")], "i int, k string")
    table = spark.createDataFrame([("a", 10), ("a", 11), ("b", 2)], "k string, v int")
    assert rows(joins.lookup(facts, "k", table, "k", "v").select("i", "k_lookup")) == [(1, 11), (2, None), (3, None)]
    assert rows(joins.orphans(facts, "k", table, "k")) == [(3, "zz")]
    got = joins.join_aggregated(facts, table, "k", "k", {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": 0})
    assert rows(got.select("i", "n", "s")) == [(1, 2, 21), (2, 0, None), (3, 0, None)]


def test_cleanse(spark):
    df = spark.createDataFrame([(" A ", "31/12/2020", "1.5", "N/A"), ("", "x", "y", " b ")], "n string, d string, v string, t string")
    got = transforms.cleanse(df, lowercase_columns=["n"], uppercase_columns=["n", "t"], date_columns={"d": "%d/%m/%Y"}, numeric_columns=["v"], keep_raw=True)
    first, second = got.collect()
    assert first["n"] == "a" and str(first["d"]) == "2020-12-31 00:00:00" and first["v"] == 1.5 and first["t"] is None
    assert second["n"] is None and second["d"] is None and second["d_raw"] == "x" and second["v_raw"] == "y" and second["t"] == "B"
    assert transforms.cleanse(df, critical_columns=["n"]).count() == 1


def test_enrich_order(spark):
    df = spark.createDataFrame([(1, None), (2, "de")], "i int, c string")
    got = transforms.enrich(df, {"c": "us", "z": 0}, {"a": F.concat("c", F.lit("!")), "b": lambda d: F.length("a")}, run_ts="2024-01-01 00:00:00", job_id="j")
    assert [tuple(r)[:5] for r in got.orderBy("i").collect()] == [(1, "us", 0, "us!", 3), (2, "de", 0, "de!", 3)]
    assert {"_etl_timestamp", "_etl_job_id"} <= set(got.columns)


def test_validate(spark):
    df = spark.createDataFrame([("abc", 5, "x"), (None, 50, "y"), ("1bc", None, None)], "s string, n int, e string")
    rules = {"s": {"required": True, "pattern": "[a-z]+"}, "n": {"type": "int", "min": 1, "max": 10}, "e": {"enum": ["x"]}, "absent": {"required": True}}
    got = [r["_validation_errors"] for r in transforms.validate(df, rules).collect()]
    assert got == [
        ["absent is required"], ["s is required", "n must be <= 10", "e must be one of ['x']", "absent is required"],
        ["s does not match pattern [a-z]+", "absent is required"],
    ]
    kept = transforms.validate(df, {k: v for k, v in rules.items() if k != "absent"}, reject_invalid=True)
    assert rows(kept) == [("abc", 5, "x", True)]


def test_mask_pii_order_and_truth(spark):
    df = spark.createDataFrame([("secret", "a@b.c", "555-1234"), ("", "x", None)], "s string, e string, p string")
    got = transforms.mask_pii(df, ["s", "absent"], {"e": "email", "p": "phone"}, ["p"]).collect()
    assert got[0]["s"] is None and len(got[0]["s_hash"]) == 64 and got[0]["e"] == "a***@b.c" and got[0]["p"] == "[REDACTED]"
    assert got[1]["s"] == "" and got[1]["s_hash"] is None and got[1]["e"] == "***" and got[1]["p"] == "[REDACTED]"


def test_soft_delete_keeps_earlier_marks(spark):
    df = spark.createDataFrame([(1,), (2,)], "i int")
    once = transforms.soft_delete(df, F.col("i") == 1, "2024-01-01 00:00:00", "u")
    twice = transforms.soft_delete(once, F.col("i") == 2, "2024-02-01 00:00:00", "v")
    assert [(r["i"], r["is_active"], r["deleted_by"]) for r in twice.orderBy("i").collect()] == [(1, False, "u"), (2, False, "v")]


def test_batches(spark):
    got = transforms.in_batches(spark.range(5), lambda b: b.assign(d=b["id"] * 2), "id long, d long")
    assert rows(got) == [(i, 2 * i) for i in range(5)]


def test_chain_counts_and_order(spark):
    loaded = []
    steps = [("double", lambda d: d.withColumn("v", F.col("id") * 2)), ("large", lambda d: d.where("v > 5")), ("none", lambda d: d.where("v < 0"))]
    counts = chain.run_chain(spark.range(6), steps, lambda d: loaded.append(d.collect()))
    assert counts == {"extracted": 6, "double": 6, "large": 3, "none": 0, "loaded": 0} and loaded == [[]]


def test_split_windows_have_a_bounded_number_of_segments(spark, monkeypatch):
    """The driver hears of each segment, so small ``hot_rows`` must not make their number follow the rows."""
    seen = []
    whole = windows._segmented
    monkeypatch.setattr(windows, "_segmented", lambda *args: seen.append(args[-1]) or whole(*args))
    rows = spark.range(600).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 7).cast("decimal(9,2)").alias("v"))
    metrics = {"n": {"function": "row_number"}, "s": {"function": "running_sum", "column": "v"}, "w": {"function": "lag", "column": "id", "window": 3}}
    split = windows.window(rows, ["g"], "id", metrics, tie_break=[], hot_rows=1)
    assert sorted(split.collect()) == sorted(windows.window(rows, ["g"], "id", metrics, tie_break=[]).collect())
    assert seen == [windows.SEGMENTS] and windows._segments(10**10, 100) == 10**10 // windows.NUMBERED_ROWS
