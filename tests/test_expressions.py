from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tellerlens.functions import expressions as X
from tellerlens.params import shift_months


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_blank_modes_differ_on_longer_padding(spark):
    df = column(spark, [None, "", " ", "   ", "x"])
    assert apply(df, X.is_blank(F.col("v"))) == [True, True, True, False, False]
    assert apply(df, X.is_blank(F.col("v"), "trim")) == [True, True, True, True, False]
    assert apply(df, X.is_set(F.col("v"))) == [False, False, False, True, True]
    assert apply(df, X.is_set(F.col("v"), "trim")) == [False, False, False, False, True]


def test_inequality_with_and_without_null(spark):
    df = column(spark, [None, "N", "Y"])
    assert df.filter(F.col("v") != "Y").count() == 1
    assert df.filter(X.not_equal_or_null(F.col("v"), "Y")).count() == 2
    assert df.filter(X.not_in_or_null(F.col("v"), ["Y", "Z"])).count() == 2


def test_key_segments(spark):
    df = column(spark, ["abc", "a~", "a~b", "a~b~", "~b~", "a~~c~", None])
    assert apply(df, X.key_segment(F.col("v"), 1)) == [None, "a", "a", "a", None, "a", None]
    assert apply(df, X.key_segment(F.col("v"), 2)) == [None, None, None, "b", "b", None, None]
    assert apply(df, X.key_segment(F.col("v"), 3)) == [None, None, None, None, None, "c", None]
    assert apply(df, X.without_last_char(F.col("v"))) == ["ab", "a", "a~", "a~b", "~b", "a~~c", None]
    assert apply(column(spark, ["x", ""]), X.without_last_char(F.col("v"))) == [None, None]


@pytest.mark.parametrize(
    "start, months, expected",
    [
        (datetime(2023, 2, 28, 8), 12, datetime(2024, 2, 29, 8)),
        (datetime(2024, 2, 29, 23, 59), -12, datetime(2023, 2, 28, 23, 59)),
        (datetime(2024, 3, 31), -1, datetime(2024, 2, 29)),
        (datetime(2024, 4, 30), -2, datetime(2024, 2, 29)),
        (datetime(2024, 4, 15, 9, 30), -24, datetime(2022, 4, 15, 9, 30)),
        (datetime(2024, 1, 30), 1, datetime(2024, 2, 29)),
    ],
)
def test_month_shift_keeps_month_end_and_time(start, months, expected):
    assert shift_months(start, months) == expected


def test_age_rounds_down_by_calendar(spark):
    days = ["2006-04-15", "2006-04-16", "2006-04-14", "1996-04-15"]
    df = column(spark, [datetime.fromisoformat(d) for d in days], "timestamp_ntz")
    age = X.years_since(F.col("v"), datetime(2024, 4, 15, 9, 30))
    assert apply(df, age >= 18) == [True, False, True, True]
    assert apply(df, age > 28) == [False, False, False, False]
    leap = column(spark, [datetime(2004, 2, 29)], "timestamp_ntz")
    assert apply(leap, X.years_since(F.col("v"), datetime(2022, 2, 28))) == [18.0]


def test_elapsed_days_count_the_time_of_day(spark):
    df = column(spark, [datetime(2024, 4, 14, 9, 30), datetime(2024, 4, 14, 9, 31)], "timestamp_ntz")
    assert apply(df, X.days_since(F.col("v"), datetime(2024, 4, 15, 9, 30))) == [1, 0]


def test_percentages_round_half_up_and_survive_empty_totals(spark):
    df = spark.createDataFrame([(0, 1, 8), (1, 1, 16), (2, 1, 3), (3, 0, 0), (4, 5, 5)], "i int, n bigint, t bigint")
    got = [None if v is None else float(v) for v in apply(df, X.percent_of(F.col("n"), F.col("t")))]
    assert got == [12.5, 6.3, 33.3, None, 100.0]


def test_mismatches(spark):
    df = spark.createDataFrame(
        [(0, "A ", "a"), (1, " A", "A"), (2, None, "A"), (3, "  ", "A"), (4, "R", "N"), (5, "N", "N")],
        "i int, a string, b string",
    )
    assert apply(df, F.coalesce(X.trimmed_differ(F.col("a"), F.col("b")), F.lit(False))) == [True, False, False, False, True, False]
    assert apply(df, F.coalesce(X.trimmed_differ(F.col("a"), F.col("b"), True), F.lit(False)))[0] is False
    mapped = X.maps_to_other(F.trim("a"), F.trim("b"), {"R": "Y", "N": "N"})
    assert apply(df, F.coalesce(mapped, F.lit(False))) == [False, False, False, False, True, False]
