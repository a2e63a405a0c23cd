import datetime as dt
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyshelf.functions import (
    label_ladder, mean_of, moment_sums, month_index, month_label, pop_sd, quotient, rnd, week_of_year,
)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("value, places, expected", [
    (1.005, 2, 1.01), (0.285, 2, 0.29), (-0.285, 2, -0.29), (2.5, 0, 3.0), (0.5, 0, 1.0), (1 / 3, 8, 0.33333333),
])
def test_round_half_away_on_the_decimal(spark, value, places, expected):
    assert one(spark, rnd(F.lit(value), places)) == expected


def test_quotient_by_zero_is_null(spark):
    assert one(spark, quotient(F.lit(1), F.lit(0))) is None
    assert one(spark, quotient(F.lit(1), F.lit(4))) == 0.25


def test_ladder_takes_the_first_rung_and_null_falls_through(spark):
    ladder = label_ladder(F.col("v"), [(">=", 3, "high"), (">", 1, "mid"), ("=", 1, "one")], "low")
    df = spark.createDataFrame([(4,), (3,), (2,), (1,), (0,), (None,)], "v int")
    got = [r.label for r in df.select(ladder.alias("label")).collect()]
    assert got == ["high", "high", "mid", "one", "low", "low"]


def moments(spark, values, parts=3):
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(parts)
    return df.agg(*moment_sums(F.col("v"), "v")).select(mean_of("v").alias("m"), pop_sd("v").alias("s")).first()


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.integers(-(2**31), 2**31 - 1), min_size=1, max_size=20))
def test_moments_are_exact(spark, values):
    got = moments(spark, values)
    assert got.m == pytest.approx(sum(values) / len(values), rel=1e-15, abs=1e-9)
    assert got.s == pytest.approx(statistics.pstdev(values), rel=1e-12, abs=1e-9)


def test_deviation_is_population_and_zero_for_flat_values(spark):
    assert moments(spark, [2, 4, 4, 4, 5, 5, 7, 9]).s == 2.0
    assert moments(spark, [7]).s == 0.0
    assert moments(spark, [3] * 50).s == 0.0
    assert moments(spark, [None, None]).s is None


def test_month_index_round_trip(spark):
    index = month_index(F.lit(dt.date(1999, 12, 31)))
    assert one(spark, month_label(index)) == "1999-12"
    assert one(spark, month_label(index + 1)) == "2000-01"


def monday_week(day):
    """Weeks 0-53 counted on the calendar: week 1 is the first with four days of its year."""
    first = dt.date(day.year, 1, 1)
    monday = first - dt.timedelta(days=first.weekday())
    started = (day - monday).days // 7
    return started + 1 if first.weekday() <= 3 else started


def test_week_of_year(spark):
    assert [monday_week(dt.date(*d)) for d in ((1999, 1, 1), (1997, 12, 30), (2001, 1, 1))] == [0, 53, 1]
    start = dt.date(1994, 1, 1)
    days = [(start + dt.timedelta(days=i),) for i in range(13_515)]
    got = spark.createDataFrame(days, "d date").select("d", week_of_year(F.col("d")).alias("w")).collect()
    assert [r for r in got if r.w != monday_week(r.d)] == []
