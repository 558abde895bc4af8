"""Random small tables: grouped metrics, pivots and de-duplication against DuckDB, with a hot key and nulls."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import aggregate as agg
from strata.operators import dedup, pivot
from strata.quality import profile
from strata.warehouse import scd
from tests.conftest import rows

duckdb = pytest.importorskip("duckdb")
SCHEMA = "id int, g string, p string, v double, o int"


@pytest.fixture(scope="module", params=[1, 2, 3])
def pair(request, spark):
    rng = random.Random(request.param)
    groups = ["hot"] * 4 + ["a", "b", None]
    data = [(i, rng.choice(groups), rng.choice(["x", "y", None]), rng.choice([None, 0.5, 1.0, 2.0, 4.0]), rng.choice([None, 1, 2, 3])) for i in range(80)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, g VARCHAR, p VARCHAR, v DOUBLE, o INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", data)
    return spark.createDataFrame(data, SCHEMA), con


def key(t):
    return [(x is not None, str(type(x)), x) for x in t]


def same(df, con, sql):
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df)]
    want = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in con.execute(sql).fetchall()), key=key)
    assert got == want


def test_aggregate(pair):
    df, con = pair
    metrics = {f: {"column": "v", "function": f} for f in ("count", "count_distinct", "sum", "avg", "min", "max", "std")}
    same(agg.aggregate(df, ["g", "p"], metrics, {"o": [1, 2, None]}, {"count": {"operator": "gt", "value": 1}}), con, """
        SELECT g, p, count(*), count(DISTINCT v), coalesce(sum(v), 0), avg(v), min(v), max(v), stddev_samp(v) FROM t
        WHERE o IN (1, 2) OR o IS NULL GROUP BY g, p HAVING count(*) > 1""")


def test_pivot(pair):
    df, con = pair
    same(pivot.pivot(df, ["g"], "p", "v", "max"), con, """
        SELECT g, max(CASE WHEN p = 'x' THEN v END), max(CASE WHEN p = 'y' THEN v END) FROM t WHERE p IS NOT NULL AND v IS NOT NULL GROUP BY g""")


@pytest.mark.parametrize("keep,direction", [("first", "ASC NULLS FIRST"), ("last", "DESC NULLS LAST")])
def test_dedup(pair, keep, direction):
    df, con = pair
    same(dedup.deduplicate(df, ["g", "p"], ["o", "id"], keep), con, f"""
        SELECT id, g, p, v, o FROM (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY o {direction}, id {direction}) AS n FROM t) WHERE n = 1""")


def test_distinct_and_top(pair):
    df, con = pair
    same(profile.distinct_counts(df, ["g", "p", "v"]), con, "SELECT 'g', count(DISTINCT g) FROM t UNION ALL SELECT 'p', count(DISTINCT p) FROM t UNION ALL SELECT 'v', count(DISTINCT v) FROM t")
    same(profile.top_values(df, ["g"], 2), con, "SELECT 'g', g, count(*), row_number() OVER (ORDER BY count(*) DESC, g) FROM t WHERE g IS NOT NULL GROUP BY g QUALIFY row_number() OVER (ORDER BY count(*) DESC, g) <= 2")


def brute_versions(target, batch):
    """Replay a batch row by row: what a loader that handles one record after the other leaves behind."""
    table = [[k, v, "t0", None, True] for k, v in target]
    for _, k, v in batch:
        current = next((r for r in table if r[0] == k and r[4]), None)
        if current is None or current[1] != v:
            if current is not None:
                current[3], current[4] = "t1", False
            table.append([k, v, "t1", None, True])
    return sorted((tuple(r) for r in table), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("hot_rows", [1000, 5])
def test_version_chain(spark, seed, hot_rows):
    rng = random.Random(seed)
    target = [(k, rng.choice(["a", "b", None])) for k in range(4)]
    batch = [(i, rng.choice([0, 0, 0, 0, 1, 2, 7, 8]), rng.choice(["a", "b", None])) for i in range(40)]
    old = spark.createDataFrame([(k, v, "t0", None, True) for k, v in target], "k int, v string, effective_date string, end_date string, is_current boolean")
    new = spark.createDataFrame(batch, "o int, k int, v string")
    got = scd.scd2(old, new, ["k"], "t1", order_by=["o"], chain=True, hot_rows=hot_rows)
    assert rows(got.drop("_action")) == brute_versions(target, batch)


def test_upsert_against_replay(spark):
    rng = random.Random(9)
    target = {k: f"old{k}" for k in range(5)}
    batch = [(i, rng.choice([0, 1, 1, 1, 6, 7]), f"v{i}") for i in range(30)]
    got = scd.upsert(spark.createDataFrame(list(target.items()), "k int, v string"), spark.createDataFrame(batch, "o int, k int, v string"), ["k"], order_by=["o"])
    for _, k, v in batch:
        target[k] = v
    assert rows(got.select("k", "v")) == sorted(target.items())
    assert got.where(F.col("_action") == "updated").count() == len({k for _, k, _ in batch} & set(range(5)))
