"""Mergeable measures of the fact, and the table that keeps them by month and series.

A measure is known as an aggregate over snapshots and as the aggregate that merges its own values. So
a report that needs only measures reads either snapshots or the far smaller rollup, and gives the same
rows: sums and moments are whole numbers, the latest values go with their day.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moment_names, moments, month_index
from ..schema import SERIES
from .load import MONTH


def _moments(value: Callable[[], Column], name: str) -> dict[str, tuple[Callable[[], Column], Callable[[], Column]]]:
    return {
        part: (lambda i=i: moments(value())[i], lambda part=part: F.sum(part))
        for i, part in enumerate(moment_names(name))
    }


def _sums(name: str, made: Callable[[], Column]):
    return {name: (made, lambda: F.sum(name))}


def _latest(name: str, source: str):
    return {name: (lambda: F.max_by(source, "snapshot_date"), lambda: F.max_by(name, "last_day"))}


#: Measure -> (aggregate over snapshots, aggregate over the measure itself).
MEASURES = {
    **_sums("days", lambda: F.count(F.lit(1))),
    **_moments(lambda: F.col("units_sold"), "sold"),
    # sales that are not negative
    **_moments(lambda: F.when(F.col("units_sold") >= 0, F.col("units_sold")), "sale"),
    **_sums("level_sum", lambda: F.sum("inventory_level")),
    **_sums("level_n", lambda: F.count("inventory_level")),
    "level_max": (lambda: F.max("inventory_level"), lambda: F.max("level_max")),
    **_sums("empty_days", lambda: F.count_if(F.col("inventory_level") == 0)),
    **_sums("idle_days", lambda: F.count_if(F.col("units_sold") == 0)),
    "first_day": (lambda: F.min("snapshot_date"), lambda: F.min("first_day")),
    "last_day": (lambda: F.max("snapshot_date"), lambda: F.max("last_day")),
    **_latest("last_level", "inventory_level"),
    **_latest("last_price", "current_price"),
    **_latest("last_sold", "units_sold"),
}

ROLLUP = "series_months"
ROLLUP_SCHEMA = (
    f"{MONTH} date, store_id string, region_id int, product_id string, days bigint, "
    "sold_n bigint, sold_sum bigint, sold_sq_high bigint, sold_sq_low bigint, "
    "sale_n bigint, sale_sum bigint, sale_sq_high bigint, sale_sq_low bigint, "
    "level_sum bigint, level_n bigint, level_max int, empty_days bigint, idle_days bigint, "
    "first_day date, last_day date, last_level int, last_price decimal(10,2), last_sold int"
)


def is_rollup(df: DataFrame) -> bool:
    return "last_day" in df.columns


def month_of(df: DataFrame) -> Column:
    """Index of the calendar month of a row of snapshots or of the rollup."""
    return month_index(F.col(MONTH if is_rollup(df) else "snapshot_date")).alias("month")


def measured(df: DataFrame, keys: Sequence[str | Column], names: Sequence[str]) -> DataFrame:
    """Measures by key, of snapshots or of the rollup."""
    merge = is_rollup(df)
    return df.groupBy(*keys).agg(*[MEASURES[n][merge]().alias(n) for n in names])


def series_months(df: DataFrame) -> DataFrame:
    """Every measure by month and series: the rollup of snapshots, or rollups of parts made one."""
    return measured(df, [MONTH, *SERIES], list(MEASURES))


def month_table(rollup: DataFrame) -> DataFrame:
    """One row per month: its first and last day and its snapshots."""
    return measured(rollup, [MONTH], ["first_day", "last_day", "days"]).withColumnRenamed("days", "rows")
