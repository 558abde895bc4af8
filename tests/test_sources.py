from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import scratch_path, shared_dir
from strata.sources import database, files, incremental, models
from tests.conftest import rows


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"\nc', None, "x"), (2, " d ", "", "y")], "i int, s string, e string, _hidden string")
    path = str(tmp_path / "out")
    files.write_files(df, path, "csv")
    back = files.read_csv(spark, path, column_mapping={"i": "id"}, multi_line=True)
    assert back.columns == ["id", "s", "e"] and [f.dataType for f in back.schema] == [T.StringType()] * 3
    assert sorted(r["s"] for r in back.collect()) == [" d ", 'a,"b"\nc']
    files.write_files(df, path, "csv", append=True)
    assert files.read_csv(spark, path, ["i", "s", "e"], multi_line=True).count() == 4
    (tmp_path / "turned.csv").write_text("b,a\n1,2\n")
    assert rows(files.read_csv(spark, str(tmp_path / "turned.csv"), ["a", "b"])) == [("2", "1")]
    (tmp_path / "semi.csv").write_text("a;b\n1;2\n")
    assert rows(files.read_csv(spark, str(tmp_path / "semi.csv"), delimiter=";")) == [("1", "2")]


def test_json_paths(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"data": {"items": [{"a": 1, "b": "x"}, {"a": 2}], "one": {"a": 3}}}, indent=1))
    path = str(tmp_path / "doc.json")
    assert rows(files.read_json(spark, path, records_path="data.items")) == [(1, "x"), (2, None)]
    assert rows(files.read_json(spark, path, records_path="data.one")) == [(3,)]
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert rows(files.read_json(spark, str(tmp_path / "list.json"), "a int")) == [(1,), (2,)]


def test_write_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    for _ in range(2):
        files.write_files(df, str(tmp_path / "j"), "json", append=True)
        files.write_files(df, str(tmp_path / "l"), "jsonl", append=True)
        files.write_files(df, str(tmp_path / "p"), "parquet", append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    assert spark.read.json(str(tmp_path / "l")).count() == 2 and spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert "b" in spark.read.json(str(tmp_path / "l")).columns
    with pytest.raises(ValueError):
        files.write_files(df, str(tmp_path / "x"), "xml")


def test_partitioned(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 3 AS k", "'h' AS _h")
    path = str(tmp_path / "p")
    for _ in range(2):
        files.write_partitioned(df, path, ["k"], "parquet")
    assert sorted(p.name for p in (tmp_path / "p").glob("k=*")) == ["k=0", "k=1", "k=2"]
    back = spark.read.parquet(path)
    assert back.count() == 200 and "_h" not in back.columns


def test_database_options():
    assert database.bind("SELECT * FROM t WHERE a = :a AND b = :ab AND c = :c", {"a": "o'x", "ab": 2, "c": None}) == "SELECT * FROM t WHERE a = 'o''x' AND b = 2 AND c = NULL"
    assert database.bind("a = :a AND b = x::int AND c = :zz", {"a": ":b", "b": 1}) == "a = ':b' AND b = x::int AND c = :zz"
    plain = database.scan_options("jdbc:x", "SELECT 1", chunk_size=50)
    assert plain == {"url": "jdbc:x", "fetchsize": "50", "query": "SELECT 1"}
    parted = database.scan_options("jdbc:x", "SELECT * FROM t", partition=("id", 0, 100, 8), driver="d")
    assert parted["dbtable"] == "(SELECT * FROM t) q" and parted["numPartitions"] == "8" and "query" not in parted
    with pytest.raises(ValueError):
        database.write_database(None, "jdbc:x", "t", if_exists="upsert")


def test_prepare_for_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, _c int")
    assert database.prepare(df, {"a": "id"}, ["id", "z"]).columns == ["id"]


def test_incremental(spark, tmp_path):
    mark, loaded = str(tmp_path / "mark"), []

    def sink(part):
        loaded.append(sorted(r["v"] for r in part.collect()))

    def table(*values):
        return spark.createDataFrame([(v,) for v in values], "v bigint")

    incremental.load_increment(table(9, 10, None), "v", mark, lambda p: sink(p.na.fill(-1)))
    aside = []
    incremental.load_increment(table(10, 11, 100, None, None), "v", mark, sink, lambda p: aside.append(p.count()))
    incremental.load_increment(table(100, None), "v", mark, lambda p: sink(p.na.fill(-1)))
    assert loaded == [[-1, 9, 10], [11, 100], [-1]] and aside == [2]

    def failing(_):
        raise RuntimeError("sink is down")

    with pytest.raises(RuntimeError):
        incremental.load_increment(table(200), "v", mark, failing)
    assert incremental.last_mark(spark, mark, T.LongType()) == "100"


def test_increment_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    plan = incremental.new_rows(spark.read.parquet(str(tmp_path / "t")), "id", "5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan


def test_models(spark, tmp_path):
    base = str(tmp_path)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    more = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")

    def run(name, *args, **kwargs):
        config = models.ModelConfig(*args, **kwargs)
        models.materialize(first, name, config, base)
        return rows(models.materialize(more, name, config, base))

    assert run("m_append", "incremental") == [(1, "a"), (2, "B"), (2, "b"), (3, "c")]
    assert run("m_merge", "incremental", "merge", ["k"]) == [(1, "a"), (2, "B"), (3, "c")]
    assert run("m_delete", "incremental", "delete+insert", ["k"]) == [(1, "a"), (2, "B"), (3, "c")]
    assert run("m_table", "table", cluster_by=["k"]) == [(2, "B"), (3, "c")]
    assert run("m_view", "view") == [(2, "B"), (3, "c")] and spark.table("m_view").count() == 2
    assert models.materialize(first, "m_none", models.ModelConfig("ephemeral"), base) is first
    stored = models.materialize(first, "m_parts", models.ModelConfig("table", partition_by=["v"]), base)
    assert sorted(p.name for p in (tmp_path / "m_parts" / "v=1").glob("v=*")) == ["v=a", "v=b"] and stored.count() == 2
    with pytest.raises(ValueError):
        models.materialize(first, "x", models.ModelConfig("incremental", "merge"), base)
    with pytest.raises(ValueError):
        models.materialize(first, "x", models.ModelConfig("cube"), base)


def test_domain_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    files.write_domain({"one": df, "two": df.where("false")}, str(tmp_path))
    back = files.read_domain(spark, str(tmp_path), {"one": df.schema, "two": df.schema})
    assert rows(back["one"]) == [(1, "a")] and back["two"].count() == 0
    assert one_file(files.scan_summary(back["one"]))


def one_file(summary):
    (row,) = summary.collect()
    return row["records"] == 1 and row["file_size"] > 0 and "one.json" in row["file_path"]


def test_shared_dir(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_raw_layer_is_compressed_and_read_back_whole(spark, tmp_path):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.lit("the same text again")).alias("note"))
    files.write_domain({"notes": rows}, str(tmp_path))
    back = files.read_domain(spark, str(tmp_path), {"notes": rows.schema})["notes"]
    assert sorted(back.collect()) == sorted(rows.collect())
    assert sum(p.stat().st_size for p in (tmp_path / "notes.json").glob("part-*")) < 5000 * 20
