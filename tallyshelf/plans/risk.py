"""Stockout risk, stockout rate and supplier inconsistency."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    INCONSISTENCY_BOUNDS, INCONSISTENCY_LABELS, INCONSISTENCY_MONTHS, LEAD_DAYS, LOW_STOCK,
    RISK_BOUNDS, RISK_LABELS, SAFETY_Z, STOCKOUT_BOUNDS, STOCKOUT_LABELS,
)
from ..functions import label_ladder, mean_of, moment_names, moment_sums, pop_sd, quotient, rnd
from ..operators import with_regions
from ..operators.regions import region_keys, with_products
from ..schema import SERIES
from .load import MONTH
from .rollup import measured
from .stock import named, safety_days

Dims = Mapping[str, DataFrame]


def stockout_risk(
    snap: DataFrame, dims: Dims, *, lead_days: int = LEAD_DAYS, z: float = SAFETY_Z,
    bounds: tuple[float, float, float] = RISK_BOUNDS, horizon: str = "linear",
) -> DataFrame:
    """Share of a series' days at or below its own reorder point, which is rounded to cents.

    The fact is read once and reduced to a cell per series and level: its days and sales moments. The
    moments of a series are window sums over its cells; then the days of the cells at or below the
    point add up. No series can outgrow a task: the snapshot key, checked at load, allows one row per
    day, whatever share of the table a store or a product holds.
    """
    cells = snap.groupBy(*SERIES, "inventory_level").agg(
        F.count(F.lit(1)).alias("days"), *moment_sums(F.col("units_sold"), "sold")
    )
    series = Window.partitionBy(*SERIES)
    cells = cells.select(
        *SERIES, "inventory_level", "days", *[F.sum(m).over(series).alias(m) for m in moment_names("sold")]
    )
    point = rnd(mean_of("sold") * lead_days + F.lit(z) * pop_sd("sold") * safety_days(lead_days, horizon), 2)
    low = F.coalesce(F.col("inventory_level") <= point, F.lit(False))
    rows = cells.groupBy(*SERIES).agg(
        F.sum(F.when(low, F.col("days")).otherwise(0)).alias("low_inventory_days"), F.sum("days").alias("total_days")
    )
    # the final sort runs its input twice, once to sample it; this keeps the join out of that
    rows = rows.repartition("store_id", "product_id")
    ratio = rnd(quotient(F.col("low_inventory_days"), F.col("total_days")), 2)
    flag = label_ladder(
        F.col("risk_ratio"), [(">=", b, text) for b, text in zip(bounds, RISK_LABELS)], RISK_LABELS[-1]
    )
    return (
        named(rows.withColumn("risk_ratio", ratio), dims)
        .orderBy(F.desc("risk_ratio"), "store_id", "region_name", "product_id")
        .select(
            "store_id", "region_name", "category", "product_id",
            "low_inventory_days", "total_days", "risk_ratio", flag.alias("risk_flag"),
        )
    )


def stockout_rate(
    snap: DataFrame, dims: Dims, *, region_via: str = "store_regions",
    bounds: tuple[float, float] = STOCKOUT_BOUNDS,
) -> DataFrame:
    """Share of days without inventory; labelled on the unrounded share."""
    rows = measured(snap, ["store_id", "product_id", *region_keys(region_via)], ["empty_days", "days"])
    rows = rows.withColumnsRenamed({"empty_days": "Stockout_Days", "days": "Total_Days"})
    share = quotient(F.col("Stockout_Days"), F.col("Total_Days"))
    label = label_ladder(
        share,
        [(">=", bounds[0], STOCKOUT_LABELS[0]), (">=", bounds[1], STOCKOUT_LABELS[1]),
         (">", 0, STOCKOUT_LABELS[2])],
        STOCKOUT_LABELS[3],
    )
    return (
        with_regions(with_products(rows, dims), dims, region_via)
        .withColumn("Stockout_Rate_Percent", rnd(share * 100, 2))
        .orderBy(F.desc("Stockout_Rate_Percent"), "region_name", "store_id", "product_id")
        .select(
            F.col("region_name").alias("Store_Region"),
            F.col("store_id").alias("Store_ID"),
            F.col("category").alias("Product_Category"),
            F.col("product_id").alias("Product_ID"),
            "Stockout_Days", "Total_Days", "Stockout_Rate_Percent",
            label.alias("Risk_Category"),
        )
    )


def last_day(snap: DataFrame, months: DataFrame | None = None) -> Column:
    """Newest snapshot date as a scalar subquery, so nothing is collected or joined.

    With the month table of a load it is read from there, else from all days of ``snap``.
    """
    if months is not None:
        return months.agg(F.max("last_day")).scalar()
    return snap.agg(F.max("snapshot_date")).scalar()


def since(snap: DataFrame, start: Column) -> DataFrame:
    """Rows from ``start`` on; a loaded fact also skips the month folders before it."""
    rows = snap.filter(F.col("snapshot_date") >= start)
    return rows.filter(F.col(MONTH) >= F.trunc(start, "MM")) if MONTH in snap.columns else rows


def supplier_inconsistency(
    snap: DataFrame, dims: Dims, *, months: int = INCONSISTENCY_MONTHS, low_stock: int = LOW_STOCK,
    bounds: tuple[float, float, float] = INCONSISTENCY_BOUNDS, region_via: str = "store_regions",
    month_table: DataFrame | None = None,
) -> DataFrame:
    """Recent low stock and the spread of orders and sales; flagged on the rounded figures."""
    recent = since(snap, F.add_months(last_day(snap, month_table), -months))
    totals = recent.groupBy("store_id", "product_id", *region_keys(region_via)).agg(
        F.count(F.lit(1)).alias("days_tracked"),
        F.count_if(F.col("inventory_level") <= low_stock).alias("low_stock_days"),
        *moment_sums(F.col("units_ordered"), "ordered"),
        *moment_sums(F.col("units_sold"), "sold"),
    )
    figures = totals.withColumns({
        "stockout_rate": rnd(quotient(F.col("low_stock_days"), F.col("days_tracked")), 2),
        "order_stddev": rnd(pop_sd("ordered"), 2),
        "avg_units_ordered": rnd(mean_of("ordered"), 2),
        "sales_stddev": rnd(pop_sd("sold"), 2),
        "avg_units_sold": rnd(mean_of("sold"), 2),
    })
    rate, order_spread, sales_spread = bounds
    stockouts, ordering, fulfillment, consistent = INCONSISTENCY_LABELS
    # a share of a figure with two decimals, rounded to rid it of binary digits: exact at a tie
    flag = (
        F.when(F.col("stockout_rate") > rate, stockouts)
        .when(F.col("order_stddev") > rnd(F.col("avg_units_ordered") * order_spread, 4), ordering)
        .when(F.col("sales_stddev") > rnd(F.col("avg_units_sold") * sales_spread, 4), fulfillment)
        .otherwise(consistent)
    )
    return (
        with_regions(figures.withColumn("inconsistency_flag", flag), dims, region_via)
        .orderBy(
            F.desc("inconsistency_flag"), F.desc("stockout_rate"), F.desc("order_stddev"),
            "store_id", "product_id", "region_name",
        )
        .select(
            "store_id", "product_id", F.col("region_name").alias("region"),
            "days_tracked", "low_stock_days", "stockout_rate",
            "order_stddev", "avg_units_ordered", "sales_stddev", "avg_units_sold",
            "inconsistency_flag",
        )
    )
