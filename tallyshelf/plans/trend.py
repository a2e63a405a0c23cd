"""Demand over the months and seasons."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SUMMARY_LABELS, TREND_DOWN, TREND_LABELS, TREND_MONTHS, TREND_UP
from ..functions import mean_of, rnd
from ..operators import trailing_months
from ..operators.regions import with_products
from .rollup import measured, month_of

KEYS = ["store_id", "product_id"]


def _trends(snap: DataFrame, months: int, up: float, down: float) -> DataFrame:
    sales = measured(snap, [*KEYS, month_of(snap)], ["sold_sum"]).withColumnRenamed("sold_sum", "sold")
    total, seen = trailing_months(KEYS, "month", "sold", months)
    sales = sales.withColumns({"before_sum": total, "before_n": seen})
    # sold against factor * mean, both multiplied by the number of months: exact at a tie
    level = F.col("sold").cast("decimal(20,0)") * F.col("before_n").cast("decimal(10,0)")
    bound = {f: F.col("before_sum").cast("decimal(20,0)") * F.lit(Decimal(str(f))) for f in (up, down)}
    upward, downward, stable = TREND_LABELS
    trend = F.when(level > bound[up], upward).when(level < bound[down], downward).otherwise(stable)
    return sales.withColumn("trend", F.when(F.col("before_n") > 0, trend))


def monthly_trend(
    snap: DataFrame, *, months: int = TREND_MONTHS, up: float = TREND_UP, down: float = TREND_DOWN,
) -> DataFrame:
    """Monthly sales against the mean of the months before; no trend where there is none."""
    return _trends(snap, months, up, down).orderBy(*KEYS, "month").select(
        *KEYS,
        (F.col("month") % 12 + 1).alias("Month"),
        F.floor(F.col("month") / 12).cast("int").alias("Year"),
        F.col("sold").alias("Total_Units_Sold"),
        rnd(mean_of("before"), 4).alias("Prev3Month_Avg"),
        F.col("trend").alias("Trend"),
    )


def demand_trend(
    snap: DataFrame, *, months: int = TREND_MONTHS, up: float = TREND_UP, down: float = TREND_DOWN,
) -> DataFrame:
    """Per calendar month over the years: how often each trend occurred and which one prevails."""
    rising, falling, flat = (F.col(c) for c in ("Upward_Count", "Downward_Count", "Stable_Count"))
    counts = (
        _trends(snap, months, up, down)
        .filter(F.col("trend").isNotNull())
        .groupBy(*KEYS, (F.col("month") % 12 + 1).alias("Month"))
        .agg(
            F.count(F.lit(1)).alias("Years_Tracked"),
            *[F.count_if(F.col("trend") == t).alias(f"{t}_Count") for t in TREND_LABELS],
        )
    )
    mostly_up, mostly_down, mostly_flat, mixed = SUMMARY_LABELS
    label = (
        F.when(rising > F.greatest(falling, flat), mostly_up)
        .when(falling > F.greatest(rising, flat), mostly_down)
        .when(flat > F.greatest(rising, falling), mostly_flat)
        .otherwise(mixed)
    )
    return counts.orderBy(*KEYS, "Month").select(
        F.col("store_id").alias("Store_ID"), F.col("product_id").alias("Product_ID"),
        "Month", "Years_Tracked", rising, falling, flat, label.alias("Avg_Trend"),
    )


def seasonal_demand(snap: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Average daily sales per category and season; days without a season do not count."""
    products = snap.filter(F.col("season_id").isNotNull()).groupBy("product_id", "season_id").agg(
        F.sum("units_sold").alias("sold_sum"), F.count("units_sold").alias("sold_n")
    )
    rows = with_products(products, dims).groupBy("category", "season_id").agg(
        F.sum("sold_sum").alias("sold_sum"), F.sum("sold_n").alias("sold_n")
    )
    return (
        rows.join(dims["seasonality"], "season_id")
        .orderBy("category", "season_name")
        .select("category", "season_name", rnd(mean_of("sold"), 4).alias("avg_units_sold"))
    )
