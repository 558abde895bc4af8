"""Named queries against their SQL. STRATA_ALL_QUERIES=1 checks every query instead of one per area."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from strata import plans
from strata.tables import TABLES
from tools.check_queries import compare

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = [
    "aggregate", "aggregate_filters_having", "pivot_prefixed", "window_rank_lag_lead", "window_split_group", "topk_values", "dedup_texts", "chain", "mask_pii", "title_case",
    "date_functions", "rule_engine", "profile_columns", "monitor_alerts", "upsert", "scd2_chain", "star_finance", "mart_account_summary", "report_university", "advisee_lists",
    "json_roundtrip", "incremental_scan", "stream_sliding", "stream_dlq",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(plans.QUERIES) if os.environ.get("STRATA_ALL_QUERIES") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    good, text = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert good, text


def test_every_query_has_sql():
    plans.load_all()
    assert set(plans.ORACLES) == set(plans.QUERIES) <= set(QUERIES)
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 150
