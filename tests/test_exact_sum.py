"""Exact sums of doubles against fractions, in windows on both paths and in groups."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest

from strata.operators import exact_sum, windows


def sample():
    rng = random.Random(3)
    powers = [[-1074, -300, 0, 5], range(-40, 40), range(-90, 30), [0], [-50, 100], [1000, 1010, 990]]
    rows = [(g, i, math.ldexp(rng.uniform(-1, 1), rng.choice(list(p)))) for g, p in enumerate(powers) for i in range(40)]
    rows += [(7, 0, 1e-12), (7, 1, 1e-12), (7, 2, math.inf), (7, 3, 1e30), (8, 0, math.inf), (8, 1, -math.inf), (9, 0, None), (9, 1, math.nan), (9, 2, 1.0)]
    return rows + [(10, 0, 1e308), (10, 1, 1e308), (10, 2, -1e308), (11, 0, None), (12, 0, -1e305), (12, 1, -2e305), (13, 0, 5e-324), (13, 1, 5e-324)]


def running(rows):
    total, odd, out = defaultdict(Fraction), defaultdict(list), {}
    for g, i, v in rows:
        if v is not None:
            if math.isfinite(v):
                total[g] += Fraction(v)
            else:
                odd[g].append(v)
        try:
            out[(g, i)] = sum(odd[g]) if odd[g] else float(total[g])
        except OverflowError:
            out[(g, i)] = math.inf
    return out


def close(a, b):
    return a == b or a != a and b != b or math.isfinite(a) and math.isfinite(b) and abs(a - b) <= math.ulp(b)


@pytest.mark.parametrize("hot_rows", [10**6, 7])
def test_running_sums_of_doubles_are_exact(spark, hot_rows):
    rows = sample()
    df = spark.createDataFrame(rows, "`g.g` long, `i.i` long, `a.v` double").repartition(5)
    out = windows.window(df, ["g.g"], "i.i", {"s": {"function": "running_sum", "column": "a.v"}, "m": {"function": "running_avg", "column": "a.v"}, "rank": {"function": "rank"}, "lag": {"function": "lag", "column": "a.v"}}, hot_rows=hot_rows)
    assert out.columns == [*df.columns, "s", "m", "rank", "lag"]
    want, got = running(rows), {(r["g.g"], r["i.i"]): r for r in out.collect()}
    assert all(close(got[k].s, w) for k, w in want.items())
    assert all(got[(g, i)]["rank"] == i + 1 for g, i, _ in rows)
    assert got[(11, 0)].m is None and got[(9, 0)].m is None and got[(10, 1)].m == math.inf


def test_exact_sums_do_not_depend_on_the_partitioning(spark):
    rows = sample()
    df = spark.createDataFrame([*rows, (0, 99, 2.0)], "`g.g` long, i long, v double").selectExpr("`g.g`", "i", "v", "CAST(v AS STRING) AS t", "CAST(i AS DECIMAL(5,1)) AS d")
    got = [sorted(exact_sum.exact_sums(df.repartition(n), ["g.g"], {"a": "v", "b": "t", "c": "d", "e": "i"}, "_n").collect(), key=lambda r: r[0]) for n in (1, 9)]
    assert str(got[0]) == str(got[1])
    want = running([*rows, (0, 99, 2.0)])
    for r in got[0]:
        last = max(i for g, i, _ in [*rows, (0, 99, 2.0)] if g == r[0])
        assert (r.a is None) == (r[0] == 11) and (r.a is None or close(r.a, want[(r[0], last)]))
        assert r.c == r.e and r.a_n == r.b_n
    assert exact_sum.exact_sums(df.where("1 = 0"), ["g.g"], {"a": "v"}).count() == 0
