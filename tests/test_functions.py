from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import casts, dates, domain, predicates, strings


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("v").alias("r")).collect()]


def test_strip_takes_all_white_space(spark):
    assert apply(spark, [" \t a b\n", None, "\u3000x\u00a0", "\x1c\u2028 é \x85"], strings.strip) == ["a b", None, "x", "é"]
    assert apply(spark, ["\u00a0a\u3000\u3000b", "\u3000"], strings.clean_string) == ["a b", ""]


def test_null_tokens(spark):
    values = ["", "NULL", "null", "None", "N/A", "n/a", "NA", "Na", "x", None]
    assert apply(spark, values, strings.null_if_token) == [None] * 7 + ["Na", "x", None]


def test_title_case(spark):
    values = ["  mary-ann o'brien 3rd ", "ÉCOLE ß", None, "x1y"]
    assert apply(spark, values, strings.title_case) == ["Mary-Ann O'Brien 3Rd", "École Ss", "", "X1Y"]


def test_clean_and_names(spark):
    assert apply(spark, ["  a \n b  ", None, ""], strings.clean_string) == ["a b", "", ""]
    df = spark.createDataFrame([("A", None), (None, None), ("A", "B")], "a string, b string")
    assert [r[0] for r in df.select(strings.full_name("a", "b")).collect()] == ["A", "", "A B"]


def test_email_domain(spark):
    assert apply(spark, ["a@B.com", "a@b@C.org", "none", None], strings.email_domain) == ["b.com", "c.org", "", ""]


def test_mask_keep_last(spark):
    assert apply(spark, ["12345678", "1234", "12", "", None], strings.mask_keep_last) == ["****5678", "****", "**", "", ""]


def test_mask_kinds(spark):
    assert apply(spark, ["john@x.com", "a@b@c", "none", "", None], lambda c: strings.mask_as(c, "email")) == ["jo***@x.com", "***", "***", "", None]
    assert apply(spark, ["555-123-4567"], lambda c: strings.mask_as(c, "phone")) == ["***-***-4567"]
    assert apply(spark, ["123-45-6789"], lambda c: strings.mask_as(c, "ssn")) == ["***-**-6789"]
    assert apply(spark, ["4111111111111111"], lambda c: strings.mask_as(c, "credit_card")) == ["****-****-****-1111"]
    with pytest.raises(ValueError):
        strings.mask_as("v", "iban")


def test_surrogate_hash_writes_none(spark):
    import hashlib

    df = spark.createDataFrame([(1, None)], "a int, b string")
    want = hashlib.md5(b"1|None").hexdigest()[:16]
    assert df.select(strings.surrogate_hash("a", "b")).first()[0] == want
    assert df.select(strings.natural_key("a", "b")).first()[0] == "1|"


def test_present_items_may_be_empty(spark):
    df = spark.range(2).select(strings.present_items(F.when(F.col("id") > 0, F.lit("a")), F.lit(None).cast("string")).alias("x"))
    assert [r[0] for r in df.orderBy(F.size("x")).collect()] == [[], ["a"]]


def test_casts(spark):
    assert apply(spark, ["12.9", "-12.9", "x", None, "1e3"], lambda c: casts.cast_to(c, "int")) == [12, -12, None, None, 1000]
    assert apply(spark, ["TRUE", "1", "yes", "no", None], lambda c: casts.cast_to(c, "bool")) == [True, True, True, False, None]
    assert apply(spark, ["2024-02-29", "2024-02-30", "2024", "2024-02-29T10:00:00"], lambda c: casts.cast_to(c, "date")) == [dt.date(2024, 2, 29), None, None, dt.date(2024, 2, 29)]
    assert apply(spark, [9007199254740993], lambda c: casts.cast_to(c, "int", T.LongType()), "bigint") == [9007199254740993]
    assert apply(spark, ["x", None], lambda c: casts.safe_cast(c, "float", -1.0)) == [-1.0, -1.0]
    with pytest.raises(ValueError):
        casts.cast_to("v", "money")


def test_datetime_pattern():
    assert casts.datetime_pattern("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    with pytest.raises(ValueError):
        casts.datetime_pattern("%q")


def test_date_diff_rounds_down(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 9), dt.date(2024, 1, 1)), (dt.date(2024, 1, 1), dt.date(2025, 1, 1))], "a date, b date")
    got = df.select(dates.date_diff("a", "b"), dates.date_diff("a", "b", "weeks"), dates.date_diff("a", "b", "months"), dates.date_diff("a", "b", "years")).collect()
    assert [tuple(r) for r in got] == [(-8, -2, -1, -1), (366, 52, 12, 1)]


def test_age_on_leap_day(spark):
    df = spark.createDataFrame([(dt.date(2000, 2, 29), dt.date(2023, 2, 28)), (dt.date(2000, 2, 29), dt.date(2023, 3, 1)), (None, dt.date(2023, 3, 1))], "b date, d date")
    assert [r[0] for r in df.select(dates.completed_years("b", "d")).collect()] == [22, 23, None]


def test_fiscal_and_trunc(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 30),), (dt.date(2024, 7, 1),)], "d date")
    got = df.select(dates.fiscal_year("d"), dates.fiscal_quarter("d"), dates.date_trunc("d", "week"), dates.date_trunc("d", "other")).collect()
    assert [tuple(r) for r in got] == [(2023, 4, dt.date(2024, 6, 24), dt.date(2024, 6, 30)), (2024, 1, dt.date(2024, 7, 1), dt.date(2024, 7, 1))]


def test_stay_and_minutes(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "2024-01-03 09:59:59"), ("2024-01-01 10:00:00", None)], "a string, b string").selectExpr("CAST(a AS TIMESTAMP) a", "CAST(b AS TIMESTAMP) b")
    assert [tuple(r) for r in df.select(dates.whole_days_between("a", "b"), dates.whole_minutes_between("a", "b")).collect()] == [(1, 2879), (None, None)]


def test_buckets_and_grades(spark):
    buckets = [(0, "Low"), (50, "Medium"), (100, "High")]
    assert apply(spark, [-5.0, 0.0, 50.0, 99.9, 100.0, None], lambda c: domain.categorize(c, buckets), "double") == ["Low", "Low", "Medium", "Medium", "High", "Unknown"]
    assert apply(spark, [95.0, 94.99, 60.0, 59.9], domain.letter_grade, "double") == ["A+", "A", "D", "F"]
    assert apply(spark, [5.0, 5.1, 0.0], lambda c: domain.above(c, [(5, "HIGH"), (0, "MEDIUM")], "LOW"), "double") == ["MEDIUM", "HIGH", "LOW"]


def test_ranges(spark):
    low, high = F.lit(10.0), F.lit(20.0)
    assert apply(spark, [7.0, 9.0, 15.0, 21.0, 25.0, None], lambda c: domain.range_flag(c, low, high), "double") == ["LL", "L", None, "H", "HH", None]
    assert apply(spark, [-1.0, 15.0, None], lambda c: domain.outside_range(c, F.lit(0.0), high, F.lit("H")), "double") == [False, False, True]
    df = spark.createDataFrame([(10, 12), (10, 3), (0, 3), (None, 3)], "cap int, n int")
    assert [r[0] for r in df.select(domain.available_seats("cap", "n")).collect()] == [0, 7, 0, 0]
    assert [r[0] for r in df.select(domain.burn_rate("n", "cap")).collect()] == [120.0, 30.0, None, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, s string")

    def kept(**filters):
        return sorted(r[0] for r in df.where(predicates.filter_condition(filters)).collect())

    assert kept(s="a") == [1]
    assert kept(s=None) == [2]
    assert kept(s=["a", None]) == [1, 2]
    assert kept(s=[]) == []
    assert kept(i=lambda c: c > 1, s=["b"]) == [3]
    assert kept() == [1, 2, 3]


def test_having(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "i int, m double")

    def kept(spec):
        return sorted(r[0] for r in df.where(predicates.having_condition({"m": spec})).collect())

    assert kept({"operator": "gt", "value": 10}) == [3]
    assert kept({"value": 10}) == [1]
    assert kept({"operator": "ne", "value": 10}) == [3]
    assert kept({"operator": "about", "value": 10}) == [1, 3]
