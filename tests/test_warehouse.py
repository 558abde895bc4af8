from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata import kpi, records
from strata.warehouse import dims, marts, scd, star
from tests.conftest import one, rows

D1, D2, D3 = dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)
DIM = "k int, v string, n int, effective_date date, end_date date, is_current boolean"


def test_date_dimension(spark):
    table = dims.date_dimension(spark)
    assert table.count() == 2192 and len(table.columns) == 18
    row = table.where("date_actual = DATE '2024-12-29'").first()
    assert (row["date_sk"], row["day_of_week"], row["day_name"], row["week_of_year"], row["is_weekend"], row["fiscal_year"], row["fiscal_quarter"]) == (1825, 6, "Sunday", 52, True, 2024, 2)
    assert row["year_quarter"] == "2024-Q4" and row["month_name_short"] == "Dec" and row["day_of_year"] == 364


def test_time_dimension(spark):
    table = dims.time_dimension(spark)
    assert table.count() == 96
    assert tuple(table.where("time_actual = '00:45:00'").first()) == (4, "00:45:00", 0, 45, 0, 12, "AM", "Night", False)
    assert table.where("is_business_hours").count() == 32
    assert dims.time_dimension(spark, 25).where("hour = 0").count() == 3
    with pytest.raises(ValueError):
        dims.time_dimension(spark, 0)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, n int")
    source = spark.createDataFrame([(2, "x", 1, 1), (2, "y", 2, 2), (3, "z", 3, 1), (None, "m", 4, 1), (None, "m", 4, 2)], "k int, v string, n int, o int")
    got = scd.upsert(target, source, ["k"], ["v"], ["o"])
    assert rows(got) == [
        (None, "m", 4, "inserted"), (None, "m", 4, "inserted"), (None, "n", 0, "kept"), (1, "a", 10, "kept"), (2, "y", 20, "updated"), (3, "z", 3, "inserted")]
    assert rows(scd.action_counts(got)) == [("inserted", 3), ("kept", 2), ("updated", 1)]
    assert rows(scd.upsert(target, source, ["k"], order_by=["o"]).where("k = 2")) == [(2, "y", 2, "updated")]


def test_scd1_keeps_surrogate_keys(spark):
    target = spark.createDataFrame([(5, "a", 1), (6, "b", 2)], "k int, v string, sk bigint")
    source = spark.createDataFrame([(6, "B"), (7, "c"), (4, "d")], "k int, v string")
    for hot in (1000, 1):
        got = scd.scd1(target, source, ["k"], "sk", hot_rows=hot)
        assert rows(got.select("k", "v", "sk")) == [(4, "d", 3), (5, "a", 1), (6, "B", 2), (7, "c", 4)]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame([
        (1, "old", 1, dt.date(2023, 1, 1), D1, False), (1, "a", 1, D1, None, True), (2, "b", 2, D1, None, True), (3, "c", 3, D1, None, True), (4, None, 4, D1, None, True),
    ], DIM)


def test_scd2(spark, history):
    source = spark.createDataFrame([(1, "a", 1), (2, "B", 2), (4, "d", 4), (5, "e", 5), (None, "n", 6)], "k int, v string, n int")
    got = scd.scd2(history, source, ["k"], "2024-02-01")
    assert rows(scd.scd2_counts(got)) == [(2, 2, 1)]
    state = {(r["k"], r["effective_date"]): (r["v"], r["end_date"], r["is_current"], r["_action"]) for r in got.collect()}
    assert state[(2, D1)] == ("b", D2, False, "expired") and state[(2, D2)] == ("B", None, True, "updated")
    assert state[(4, D1)] == (None, D2, False, "expired") and state[(3, D1)] == ("c", None, True, "untouched")
    assert state[(1, dt.date(2023, 1, 1))] == ("old", D1, False, "history") and state[(1, D1)][3] == "unchanged" and len(state) == 9
    again = scd.scd2(got.drop("_action"), source.where("k IS NOT NULL"), ["k"], "2024-03-01")
    assert rows(again.drop("_action")) == rows(got.drop("_action"))
    assert rows(scd.scd2_counts(again)) == [(0, 0, 4)]


def test_scd2_tracks_listed_columns_only(spark, history):
    source = spark.createDataFrame([(2, "b", 99), (3, "C", 3)], "k int, v string, n int")
    got = scd.scd2(history, source, ["k"], "2024-02-01", ["v"])
    assert rows(scd.scd2_counts(got)) == [(0, 1, 1)]
    assert rows(got.where("k = 2").select("n", "is_current")) == [(2, True)]


def test_scd2_repeated_key(spark, history):
    source = spark.createDataFrame([(2, "x", 2, 1), (2, "y", 2, 2), (2, "y", 2, 3), (6, "p", 6, 1), (6, "q", 6, 2), (3, "c", 3, 1)], "k int, v string, n int, o int")
    last = scd.scd2(history, source, ["k"], "2024-02-01", order_by=["o"])
    assert rows(last.where("k = 2 AND is_current").select("v")) == [("y",)] and last.where("k = 6").count() == 1
    chain = scd.scd2(history, source, ["k"], "2024-02-01", order_by=["o"], chain=True)
    assert rows(chain.where("k IN (2, 6)").select("k", "v", "end_date", "is_current")) == [
        (2, "b", D2, False), (2, "x", D2, False), (2, "y", None, True), (6, "p", D2, False), (6, "q", None, True)]
    assert rows(chain.where("k = 3").select("v", "is_current")) == [("c", True)]


def test_scd2_with_surrogate_keys(spark, history):
    keyed = scd.assign_surrogate_keys(history.withColumn("sk", F.lit(None).cast("bigint")), "sk", ["k", "effective_date"])
    source = spark.createDataFrame([(2, "B", 2), (9, "z", 9)], "k int, v string, n int")
    got = scd.scd2(keyed, source, ["k"], "2024-02-01", surrogate="sk")
    assert sorted(r["sk"] for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert rows(got.where("is_current AND k IN (2, 9)").select("k", "sk")) == [(2, 6), (9, 7)]


def test_star_definitions():
    assert [len(s.fact.foreign_keys) for s in star.STARS.values()] == [5, 5, 4, 4]
    for s in star.STARS.values():
        assert s.unknown_dimensions() == []
        assert set(s.fact.foreign_keys.values()) <= set(s.dimensions)
    assert star.Star("x", star.Fact("f", "p", "d", {"ghost_sk": "dim_ghost"}, ()), {}).unknown_dimensions() == ["ghost_sk"]


def test_health_star(spark, tmp_path):
    data = {
        "patients": spark.createDataFrame([("P1", "A", "MI"), ("P2", "B", "OH")], "patient_id string, first_name string, state string"),
        "providers": spark.createDataFrame([("D1", "X")], "provider_id string, first_name string"),
        "encounters": spark.createDataFrame([("E1", "P2", "D1", "EMERGENCY", "2024-01-02 09:20:00", 10.0), ("E2", None, "D9", "OTHER", "2024-01-01 00:00:00", None)],
                                            "encounter_id string, patient_id string, provider_id string, encounter_type string, encounter_date string, total_charges double")
        .withColumn("encounter_date", F.col("encounter_date").cast("timestamp")),
    }
    tables = star.build_health(data, "2024-01-01", spark)
    fact = tables["fact_encounter"]
    got = {r["encounter_id"]: r for r in fact.collect()}
    e1, e2 = got["E1"], got["E2"]
    assert (e1["patient_sk"], e1["provider_sk"], e1["date_sk"], e1["time_sk"], e1["total_charges"]) == (2, 1, 2, 38, 10.0)
    types = dict(rows(tables["dim_encounter_type"].select("encounter_type_code", "encounter_type_sk")))
    assert e1["encounter_type_sk"] == types["EMERGENCY"] and e2["patient_sk"] is None and e2["provider_sk"] is None and e2["encounter_type_sk"] is None
    star.save(tables, star.HEALTH.name, str(tmp_path))
    counts = dict(rows(star.table_counts(spark, list(tables), star.HEALTH.name, str(tmp_path))))
    assert counts == {"dim_date": 2, "dim_time": 96, "dim_encounter_type": 4, "dim_patient": 2, "dim_provider": 1, "fact_encounter": 2}
    lost = star.star_orphans(fact.withColumn("patient_sk", F.coalesce("patient_sk", F.lit(77))), {"patient_sk": (tables["dim_patient"], "patient_sk")})
    assert rows(lost) == [("patient_sk", 1)]


def test_marts(spark):
    patients = spark.createDataFrame([("1", " ann ", "o'neil", True), ("2", None, "x", None)], "patient_id string, first_name string, last_name string, is_deceased boolean")
    encounters = spark.createDataFrame([("a", "1", "X", None, "600.005"), ("b", "1", "X", None, None)], "encounter_id string, patient_id string, encounter_type string, encounter_date timestamp, total_charges string")
    staged = marts.stg_patients(patients)
    assert rows(staged.select("first_name", "last_name", "full_name", "is_active")) == [("", "X", "x", True), ("Ann", "O'Neil", "ann  o'neil", False)]
    summary = marts.mart_patient_summary(marts.int_patient_encounters(staged.withColumn("state", F.lit("MI")), marts.stg_encounters(encounters)))
    assert rows(summary.select("patient_id", "encounter_count", "total_charges", "avg_charge_per_encounter", "patient_segment")) == [
        ("1", 2, 600.01, 300.01, "Low Value"), ("2", 0, 0.0, 0.0, "Low Value")]


def test_kpis_over_empty_and_zero(spark):
    empty = spark.createDataFrame([], "total_charges double, encounter_type string")
    assert rows(kpi.encounters(empty).select("metric", "value")) == [("total_encounters", 0.0)]
    some = spark.createDataFrame([(0.0, "A"), (10.0, None), (None, "A")], "total_charges double, encounter_type string")
    got = {(r["metric"], r["category"]): r["value"] for r in kpi.encounters(some).collect()}
    assert got == {("total_encounters", None): 3.0, ("avg_encounter_charge", None): 10.0, ("encounters_by_type", "A"): 2.0, ("encounters_by_type", None): 1.0}
    done = spark.createDataFrame([("COMPLETED", "A"), ("COMPLETED", "F"), ("COMPLETED", None), ("ENROLLED", "B")], "status string, grade string")
    got = {(r["metric"], r["category"]): r["value"] for r in kpi.enrollments(done).collect()}
    assert got[("pass_rate", None)] == 0.3333 and got[("grade_distribution", "F")] == 1.0


def test_records(spark):
    students = spark.createDataFrame([(i, f"s{i}", i % 2 if i else None) for i in range(6)], "id int, name string, advisor int")
    faculty = spark.createDataFrame([(0, "f0"), (7, "f7")], "id int, name string")
    assert one(records.summary(students, "id")) == (6, 0, 5, 2.5)
    assert one(records.summary(students, "id", hot_rows=2)) == (6, 0, 5, 2.5)
    assert rows(records.ends(students, "id", ["name"])) == [("max", 5, "s5"), ("min", 0, "s0")]
    assert rows(records.contains(students, "id", faculty, "id")) == [(0, True), (7, False)]
    assert records.delete(students, "id", faculty, "id").count() == 5
    assert rows(records.find(students, "id", 3).select("name")) == [("s3",)]
    for hot_rows in (2_000_000, 1):
        assert rows(records.advisee_lists(students, page_size=2, hot_rows=hot_rows)) == [(0, 1, [2, 4]), (1, 1, [1, 3]), (1, 2, [5])]
    assert rows(records.with_advisor(students, faculty).where("id < 3").select("id", "advisor_name")) == [(0, None), (1, None), (2, "f0")]
    changed = records.reassign(students, spark.createDataFrame([(1, 7), (2, None)], "id int, advisor int"))
    assert rows(changed.where("id < 4").select("id", "advisor")) == [(0, None), (1, 7), (2, None), (3, 1)]
    assert records.insert(students, students).count() == 12
