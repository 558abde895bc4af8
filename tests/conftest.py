from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.session import build_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("strata-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session
    session.stop()


def rows(df):
    """Rows as a list of tuples, sorted with nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in t])


def one(df):
    (row,) = df.collect()
    return tuple(row)
