"""Merges by bucket against merges of the whole table; relations; panes."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import dedup, pivot, transforms
from strata.quality import relations
from strata.session import scratch_path
from strata.sources import files
from strata.streaming import windows
from strata.warehouse import bucketed, scd
from tests.conftest import rows


def test_merge_writes_touched_buckets_only(spark):
    target = spark.createDataFrame([(i, i % 3 and f"k{i}", i * 1.5) for i in range(200)] + [(None, "n", 0.0)], "id long, `a.b` string, v double")
    path = scratch_path(spark, "bucketed")
    bucketed.create(target, path, ["id"], 16)
    before = bucketed.snapshot(spark, path)
    assert rows(before.rows(spark)) == rows(target)
    batch = spark.createDataFrame([(3, "x", 1.0, 1), (3, "y", 2.0, 2), (500, "z", 3.0, 1), (None, "m", 4.0, 1)], "id long, `a.b` string, v double, o int")
    old = {f: os.stat(f).st_mtime_ns for f in (os.path.join(d, x) for d, _, names in os.walk(f"{path}/data") for x in names)}
    after = bucketed.merge(spark, path, batch, order_by=["o"])
    assert rows(after.rows(spark)) == rows(scd.upsert(target, batch, ["id"], order_by=["o"]).drop("_action"))
    assert all(os.stat(f).st_mtime_ns == t for f, t in old.items())  # nothing that stood there was written
    figures = bucketed.files_left(spark, before, after).first()
    assert 1 <= figures.buckets_written <= 3 and figures.buckets_kept == len(before.written) - sum(b in before.written for b, v in after.written.items() if v == 1)
    assert rows(bucketed.snapshot(spark, path, 0).rows(spark)) == rows(target)
    again = bucketed.merge(spark, path, batch.where("1 = 0"))
    assert again.written == after.written and again.version == 2


def test_merge_of_versions_and_of_an_empty_table(spark):
    fields = "id long, v string, effective_date date, end_date date, is_current boolean"
    path = scratch_path(spark, "versions")
    bucketed.create(spark.createDataFrame([], fields), path, ["id"], 8)
    assert bucketed.snapshot(spark, path).rows(spark).count() == 0
    one = spark.createDataFrame([(i, "a") for i in range(20)], "id long, v string")
    two = spark.createDataFrame([(3, "b"), (4, "a"), (99, "c")], "id long, v string")
    for day, batch in (("2024-01-01", one), ("2024-02-01", two)):
        now = bucketed.merge(spark, path, batch, change=lambda old, new, day=day: scd.scd2(old, new, ["id"], day))
    whole = scd.scd2(scd.scd2(spark.createDataFrame([], fields), one, ["id"], "2024-01-01").drop("_action"), two, ["id"], "2024-02-01").drop("_action")
    assert rows(now.rows(spark)) == rows(whole)
    with pytest.raises(ValueError):
        bucketed.create(one.withColumn("Bucket", F.lit(1)), path, ["id"])


def test_relations_are_audited_together(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "x"), (7, "q")], "p long, c string"),
        "b": spark.createDataFrame([(1,), (1,), (2,), (None,)], "id int"), "c": spark.createDataFrame([("x",)], "code string"), "d": spark.createDataFrame([], "id long"),
    }
    known = [relations.Relation("a", "p", "b", "id"), relations.Relation("a", "c", "c", "code"), relations.Relation("a", "p", "d", "id"), relations.Relation("d", "id", "b", "id"), relations.Relation("d", "id", "d", "id")]
    got = relations.audit(tables.__getitem__, known).select("relation", "parent", "children", "nulls", "orphans", "orphan_keys", "parents")
    assert rows(got) == sorted([("a.p", "b", 5, 1, 1, 1, 2), ("a.c", "c", 5, 1, 2, 2, 1), ("a.p", "d", 5, 1, 4, 3, 0), ("d.id", "b", 0, 0, 0, 0, 2), ("d.id", "d", 0, 0, 0, 0, 0)])
    assert relations.present(relations.RELATIONS, {"encounters": ["patient_id"], "patients": ["patient_id"]}) == [relations.RELATIONS[0]]
    assert len({(r.child, r.column) for r in relations.RELATIONS}) == len(relations.RELATIONS)


@pytest.mark.parametrize("size,slide", [(60, 20), (60, 25), (90, 60), (60, 60), (30, 45)])
def test_windows_from_panes_equal_windows_from_rows(spark, size, slide):
    rng = random.Random(size + slide)
    data = [(rng.randrange(4), f"2024-01-01 00:{rng.randrange(10):02d}:{rng.randrange(60):02d}", rng.randrange(100)) for _ in range(300)]
    df = spark.createDataFrame(data, "key long, at string, v long")
    parts = windows.panes(df.where("v < 50"), "key", "v", "at", size, slide).unionByName(windows.panes(df.where("v >= 50"), "key", "v", "at", size, slide))
    want = {}
    for key, at, v in data:
        t = int(at[14:16]) * 60 + int(at[17:])
        for start in range((t // slide) * slide, t - size, -slide):
            n, s = want.get((key, start), (0, 0))
            want[(key, start)] = (n + 1, s + v)
    base = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = windows.merged_panes(parts, size, slide).select("key", (F.unix_seconds("window_start") - base).alias("s"), (F.unix_seconds("window_end") - base).alias("e"), "count", "sum").collect()
    assert {(r.key, r.s): (r["count"], r["sum"]) for r in got} == want and all(r.e - r.s == size for r in got)


def test_computed_fields_that_fail_are_null(spark):
    df = spark.createDataFrame([("1", 2, [5]), ("x", 0, [])], "t string, d int, l array<int>")
    got = transforms.enrich(df, computed_fields={"n": F.col("t").cast("int"), "q": F.lit(4) / F.col("d"), "e": lambda rows: F.col("l")[0], "m": F.col("n") + 1})
    assert [tuple(r)[3:] for r in got.collect()] == [(1, 2.0, 5, 2), (None, None, None, None)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_csv_folder_with_other_headers_is_refused(spark):
    folder = scratch_path(spark, "csv")
    os.makedirs(folder)
    for name, text in (("1.csv", "a,b\n1,2\n"), ("2.csv", "b,a\n3,4\n")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="[Hh]eader"):
        files.read_csv(spark, folder).collect()
    with open(f"{folder}/2.csv", "w") as f:
        f.write("a,b\n4,3\n")
    assert rows(files.read_csv(spark, folder)) == [("1", "2"), ("4", "3")]


def test_names_and_values_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, "x`y", 2.0, 1), (1, "x`y", 3.0, 2), (1, "p.q", 4.0, 3)], "`i.d` long, `k.k` string, v double, `o.o` int")
    wide = pivot.pivot(df, ["i.d"], "k.k", "v")
    assert wide.columns == ["i.d", "k.k_p.q", "k.k_x`y"] and tuple(wide.first()) == (1, 4.0, 5.0)
    assert rows(dedup.deduplicate(df, ["i.d", "k.k"], ["o.o"], keep="last").select("v")) == [(3.0,), (4.0,)]
    merged = scd.upsert(df.where("`o.o` = 1"), df.where("`o.o` > 1"), ["i.d", "k.k"], order_by=["o.o"])
    assert sorted(r["_action"] for r in merged.collect()) == ["inserted", "updated"]
