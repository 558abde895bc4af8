from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from strata.quality import monitor, profile, rules
from tests.conftest import one, rows


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "PAT00000001", " ", "M", "70"), (2, "PAT1", "x", "Q", "abc"), (3, None, "y", None, "300"), (4, "PAT00000001", "z", "F", None)]
    return spark.createDataFrame(data, "id int, patient_id string, first_name string, gender string, heart_rate string")


def found(df, rule_list, **kwargs):
    return rows(rules.failures(df, rule_list, "id", **kwargs).select("record_id", "rule_name", "field_name"))


def test_each_rule(people):
    assert found(people, [rules.required("first_name"), rules.required("patient_id")]) == [("1", "required", "first_name"), ("3", "required", "patient_id")]
    assert [r[0] for r in found(people, [rules.range_check("heart_rate", 30, 220)])] == ["2", "3"]
    assert [r[0] for r in found(people, [rules.pattern("patient_id", r"PAT\d{8}$")])] == ["2"]
    assert [r[0] for r in found(people, [rules.pattern("patient_id", r"AT")])] == ["1", "2", "4"]
    assert [r[0] for r in found(people, [rules.enum_check("gender", ["M", "F"])])] == ["2"]
    assert [r[0] for r in found(people, [rules.custom("first_name", lambda c: F.when(c != "x", c != "y"))])] == ["2", "3"]
    assert [r[0] for r in found(people, [rules.type_check("gender", "int"), rules.type_check("id", "int"), rules.type_check("gender", "no such type")])] == ["1", "2", "4"]
    assert [r[0] for r in found(people, [rules.unique("patient_id")])] == ["4"]
    assert len(found(people, [rules.required("absent")])) == 4
    assert found(people, [rules.pattern("absent", "x"), rules.unique("absent")]) == []


def test_uniqueness_of_a_hot_value(spark):
    df = spark.createDataFrame([(i, "same") for i in range(30)] + [(99, "other"), (100, None), (101, None)], "id int, v string")
    plain, split = (found(df, [rules.unique("v")], hot_rows=h) for h in (1000, 4))
    assert plain == split and {r[0] for r in split} == {str(i) for i in range(1, 30)}


def test_uniqueness_with_many_repeated_values(spark):
    df = spark.createDataFrame([(i, i // 2 if i < 20 else i) for i in range(100)] + [(100, None), (101, None)], "id int, v int")
    few = found(df, [rules.unique("v")])
    assert few == found(df, [rules.unique("v")], hot_rows=1) and {int(r[0]) for r in few} == set(range(1, 20, 2))


def test_repeat_number_leaves_nulls_alone(spark):
    from strata.operators.dedup import repeat_number

    for ids in ([None, None, None, 1, 1], [None, None, None, 1, 2], [1, 1, 1, 1, None]):
        df = spark.createDataFrame(list(enumerate(ids)), "n int, v int")
        got = rows(repeat_number(df, "v", ["n"], "k").where("v IS NULL").select("k"))
        assert got == [(1,)] * ids.count(None)


def test_report(people):
    rule_list = [rules.required("first_name"), rules.enum_check("gender", ["M"], rules.WARNING), rules.required("gender", rules.INFO), rules.unique("patient_id")]
    assert one(rules.report(people, rule_list, ["id"])) == (4, 2, 2, 0.5, 2, 2)
    assert one(rules.report(people.where("false"), rule_list, ["id"])) == (0, 0, 0, 0.0, 0, 0)


def test_business_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, n int")
    rule = rules.business("small", F.col("n") < 10, "too large", rules.WARNING)
    got = rows(rules.failures(df, [rule], "id").select("record_id", "severity", "message"))
    assert got == [("2", "WARNING", "too large"), ("3", "ERROR", "Rule could not be evaluated")]


def test_rule_sets(people):
    assert [len(r) for r in rules.DOMAIN_RULES.values()] == [10, 8, 8, 10]
    assert [r.kind for r in rules.from_schema(rules.CATALOGUE["health"])].count("range_check") == 3
    assert one(rules.report(people, rules.HEALTH_RULES, ["id"]))[:3] == (4, 0, 4)


def test_constraints(spark):
    df = spark.createDataFrame([(1, 1), (1, -1), (2, None)], "k int, v int")
    assert rows(rules.duplicate_keys(df, ["k"])) == [(1, 2)]
    assert rows(rules.check_constraint(df, F.col("v") >= 0)) == [(1, -1)]


def test_profile(spark):
    df = spark.createDataFrame([(1, 1.0, "2024-01-01", None, "a"), (2, 4.0, "2024-01-02T00:00", None, "bbb"), (3, None, "x", None, None), (3, 2.5, "01/02/2024", None, "a")],
                               "i int, f double, d string, n string, s string")
    got = {r["column_name"]: r for r in profile.profile_columns(df).collect()}
    assert {k: r["data_type"] for k, r in got.items()} == {"i": "int", "f": "float", "d": "date", "n": "null", "s": "string"}
    assert (got["f"]["null_count"], got["f"]["median_value"], got["f"]["mean_value"], got["f"]["sum_value"]) == (1, 2.5, 2.5, 7.5)
    assert (got["i"]["median_value"], got["i"]["unique_count"], got["i"]["uniqueness_rate"]) == (2.5, 3, 0.75)
    assert (got["s"]["min_length"], got["s"]["max_length"], got["s"]["avg_length"]) == (1, 3, 1.67)
    assert got["d"]["min_length"] is None and got["n"]["uniqueness_rate"] == 0.0 and got["n"]["completeness"] == 0.0
    assert one(profile.profile_dataset(df, "t")) == ("t", 4, 5, 0, 0.0, 0.7)
    assert one(profile.profile_dataset(df.where("false"), "t")) == ("t", 0, 5, 0, 0.0, 0.0)


def test_profile_of_one_row(spark):
    r = profile.profile_columns(spark.createDataFrame([(7,)], "i int")).first()
    assert r["mean_value"] == 7.0 and r["median_value"] is None and r["std_dev"] is None


def test_long_texts_stay_apart(spark):
    df = spark.createDataFrame([("x" * 100 + c,) for c in "aab"], "t string")
    assert one(profile.distinct_counts(df, ["t"])) == ("t", 2)


def test_top_values_of_long_texts(spark, monkeypatch):
    head = "h" * profile.HEAD
    texts = [head + x for x in "baca"] + [head] * 2 + ["h" * 500 + str(i % 40) for i in range(90)] + ["\u00e9" * 64 + "z", "", "", None]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "`a.b` string, v int").repartition(7)
    want = sorted(Counter(t for t in texts if t is not None).items(), key=lambda x: (-x[1], x[0].encode()))
    for n in (3, 12, 200):
        for bound in (0, 200_000):
            monkeypatch.setattr(profile, "FETCHED", bound)
            got = profile.top_values(df, ["a.b"], n).orderBy("position").collect()
            assert [(r.value, r.n) for r in got] == want[:n] and [r.position for r in got] == list(range(1, len(got) + 1))
    assert profile.top_values(df.where("1 = 0")).count() == 0


def test_top_values(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None]], "v string")
    assert [tuple(r) for r in profile.top_values(df, n=2).orderBy("position").collect()] == [("v", "a", 2, 1), ("v", "b", 2, 2)]


def test_drift(spark):
    a = profile.profile_columns(spark.createDataFrame([(1, "x"), (2, "y")], "k int, gone string"))
    b = profile.profile_columns(spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, new double"))
    got = {r["column_name"]: (r["change"], r["null_rate_changed"], r["unique_count_changed"]) for r in profile.drift(a, b).collect()}
    assert got == {"k": ("modified", True, True), "gone": ("removed", False, False), "new": ("added", False, False)}


def test_score(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "b")], "k int, v string")
    args = profile.profile_columns(df), profile.profile_dataset(df, "t")
    row = profile.quality_score(*args, "k").first()
    assert (row["completeness"], row["uniqueness"], row["validity"], row["consistency"]) == (75.0, 75.0, 100.0, 75.0)
    assert (row["overall_score"], row["grade"]) == (82.5, "B")
    checked = profile.quality_score(*args, "k", rules.report(df, [rules.required("v")], ["k"])).first()
    assert (checked["validity"], checked["overall_score"], checked["grade"]) == (50.0, 67.5, "D")


def test_monitoring(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, None, None)], "k int, v string, t string").withColumn("t", F.col("t").cast("timestamp"))
    metrics = monitor.metrics_frame(profile.profile_columns(df), profile.profile_dataset(df, "d"), monitor.freshness(df, "t", "2024-01-02 12:00:00"))
    rule_list = [monitor.completeness_rule("v", 0.9), monitor.uniqueness_rule("k"), *monitor.row_count_rules(5, 1), monitor.freshness_rule(24), monitor.completeness_rule("k"),
                 monitor.MonitorRule("odd", "row_count", "about", 1), monitor.MonitorRule("none", "columns.absent.null_rate", "gt", 0)]
    got = monitor.alerts(metrics, rule_list, "2024-01-02 12:00:00").orderBy("alert_id").collect()
    assert [(r["alert_id"], r["title"], r["metric_value"]) for r in got] == [
        ("ALT-20240102-0001", "completeness_v", 0.5), ("ALT-20240102-0002", "uniqueness_k", 0.5), ("ALT-20240102-0003", "min_row_count", 2.0),
        ("ALT-20240102-0004", "max_row_count", 2.0), ("ALT-20240102-0005", "data_freshness", 36.0)]
    frame = spark.createDataFrame(got, monitor.alerts(metrics, rule_list, "2024-01-02 12:00:00").schema)
    left = monitor.active_alerts(monitor.acknowledge(frame, "ALT-20240102-0001", "me", "2024-01-03 00:00:00"), "HIGH")
    assert sorted(r["title"] for r in left.collect()) == ["data_freshness", "uniqueness_k"]

    def broken(_):
        raise RuntimeError("down")

    path = str(tmp_path / "alerts")
    problems = monitor.route(frame, {"HIGH": [broken, lambda a: monitor.append_alerts(a, path)]})
    assert list(problems) == ["HIGH[0]"] and spark.read.json(path).count() == 3
    history = str(tmp_path / "history")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        monitor.append_history(metrics, "d", f"{day} 00:00:00", history)
    assert [str(r[0])[:10] for r in monitor.trend(spark.read.parquet(history), "d", "row_count", 2).collect()] == ["2024-01-03", "2024-01-02"]


def test_freshness_without_timestamps(spark):
    df = spark.createDataFrame([(None,)], "t timestamp")
    assert one(monitor.freshness(df, "t", "2024-01-01 00:00:00")) == (float("inf"),)


def test_gate(spark):
    def gate(values):
        return one(monitor.quality_gate(spark.createDataFrame([(v,) for v in values], "overall_score double")))

    assert gate([80.0, 80.0, 0.0, None]) == (80.0, "transform")
    assert gate([79.0, 80.0]) == (79.5, "quality_alert")
    assert gate([None]) == (0.0, "quality_alert")
