"""How fast stock moves: turnover, sell-through, age and dead stock."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import GROWTH, PERIOD_DAYS, TURNOVER_HIGH, TURNOVER_LABELS, TURNOVER_MODERATE
from ..functions import label_ladder, mean_of, month_label, quotient, rnd
from ..operators import replenishments, with_regions
from ..operators.regions import region_keys
from ..schema import SERIES
from ..sources.clean import clean_text, parse_month
from .rollup import measured, month_of
from .stock import named

Dims = Mapping[str, DataFrame]


def monthly_turnover(
    snap: DataFrame, dims: Dims, *, high: float = TURNOVER_HIGH, moderate: float = TURNOVER_MODERATE,
    period_days: int = PERIOD_DAYS,
) -> DataFrame:
    """Units sold over average inventory per month and series; labelled on the rounded ratio."""
    totals = measured(snap, [month_of(snap), *SERIES], ["sold_sum", "level_sum", "level_n"])
    totals = totals.withColumnRenamed("sold_sum", "Total_Units_Sold")
    ratio = quotient(F.col("Total_Units_Sold"), mean_of("level"))
    rounded = rnd(ratio, 2)
    label = label_ladder(
        rounded,
        list(zip((">", ">", ">"), (high, moderate, 0), TURNOVER_LABELS)),
        TURNOVER_LABELS[-1],
    )
    return (
        named(totals, dims)
        .orderBy("month", "store_id", "region_name", "category", "product_id")
        .select(
            month_label(F.col("month")).alias("YearMonth"),
            "store_id", "region_name", "product_id", "category", "Total_Units_Sold",
            rnd(mean_of("level"), 4).alias("Avg_Inventory_Level"),
            rounded.alias("Inventory_Turnover_Ratio"),
            label.alias("Turnover_Category"),
            rnd(quotient(F.lit(period_days), ratio), 1).alias("Days_To_Sell_Inventory"),
        )
    )


def sell_through(sold: Column, stock: Column) -> Column:
    """Share of the available units that were sold, in percent."""
    return rnd(quotient(sold, sold + stock) * 100, 2)


def sell_through_region_month(
    snap: DataFrame, dims: Dims, *, region_via: str = "store_regions",
) -> DataFrame:
    """Monthly sell-through of a region against the mean of its daily inventory totals.

    Reduced to a row per store and day before stores fan out to their regions.
    """
    keys = [*region_keys(region_via), "snapshot_date"]
    if region_via == "store_regions":
        keys = ["store_id", *keys]
    days = snap.groupBy(*keys).agg(
        F.sum("units_sold").alias("sold"), F.sum("inventory_level").alias("level")
    )
    if region_via == "store_regions":
        bridge = dims["store_regions"].select("store_id", "region_id")
        days = days.join(bridge, "store_id").groupBy("region_id", "snapshot_date").agg(
            F.sum("sold").alias("sold"), F.sum("level").alias("level")
        )
    # the label is made from an aggregate: a filter on it then stays on the monthly rows, where a
    # filter on the grouping key would be pushed down and format every day of the fact
    months = days.groupBy("region_id", month_of(days)).agg(
        F.sum("sold").alias("sold"), F.sum("level").alias("level_sum"), F.count("level").alias("level_n"),
        F.max("snapshot_date").alias("last_day"),
    )
    months = months.withColumn("level", rnd(mean_of("level"), 2))
    return (
        months.join(dims["regions"], "region_id")
        .orderBy("month", "region_name")
        .select(
            F.date_format("last_day", "yyyy-MM").alias("Month"),
            F.col("region_name").alias("Region"),
            F.col("sold").alias("Total_Units_Sold"),
            F.col("level").alias("Weighted_Avg_Inventory"),
            sell_through(F.col("sold"), F.col("level")).alias("Sell_Through_Rate_Percent"),
        )
    )


def clean_region_month(report: DataFrame) -> DataFrame:
    """A sell-through report ready to plot: clean texts, months as dates, unreadable months gone."""
    return parse_month(clean_text(report, ["Region", "Month"]), "Month")


def sell_through_store_month(
    snap: DataFrame, dims: Dims, *, region_via: str = "store_regions",
) -> DataFrame:
    """Monthly sell-through of a store against its largest inventory, shown for each region."""
    months = measured(snap, [month_of(snap), "store_id", *region_keys(region_via)], ["sold_sum", "level_max"])
    months = months.withColumnsRenamed({"sold_sum": "sold", "level_max": "level"})
    return (
        with_regions(months, dims, region_via)
        .orderBy("month", "region_name", "store_id")
        .select(
            month_label(F.col("month")).alias("Month"),
            F.col("region_name").alias("Region"),
            F.col("store_id").alias("Store_ID"),
            F.col("sold").alias("Total_Units_Sold"),
            F.col("level").alias("Ending_Inventory"),
            sell_through(F.col("sold"), F.col("level")).alias("Sell_Through_Rate_Percent"),
        )
    )


def inventory_age(
    snap: DataFrame, dims: Dims | None = None, *, growth: tuple[int, int] = GROWTH
) -> DataFrame:
    """Days between the last replenishment and the last day of a store's product.

    A level is compared with the row before, regions of one day in order of their name, whatever ids
    the loads gave them; without ``dims`` in order of the id. Products never replenished are left out.
    Rows carry the place of their region's name, a number, not the name.
    """
    tie = "region_id" if dims is None else "region_rank"
    rows = snap
    if dims is not None:
        rank = F.row_number().over(Window.orderBy("region_name"))  # a row a region
        ranks = dims["regions"].select("region_id", rank.alias("region_rank"))
        rows = snap.select("snapshot_date", "store_id", "product_id", "region_id", "inventory_level").join(ranks, "region_id")
    rows = replenishments(rows, ["store_id", "product_id"], tie, growth)
    age = F.datediff("latest_date", "last_replenishment")
    return (
        rows.filter(F.col("last_replenishment").isNotNull())
        .withColumn("Inventory_Age_Days", age)
        .orderBy(F.desc("Inventory_Age_Days"), "store_id", "product_id")
        .select(
            F.col("store_id").alias("Store_ID"),
            F.col("product_id").alias("Product_ID"),
            F.date_format("last_replenishment", "yyyy-MM-dd").alias("Last_Replenishment_Date"),
            F.date_format("latest_date", "yyyy-MM-dd").alias("Latest_Date"),
            "Inventory_Age_Days",
        )
    )


def dead_stock(snap: DataFrame) -> DataFrame:
    """Share of days without a sale per store and product; shown where it does not round to 0."""
    rows = measured(snap, ["store_id", "product_id"], ["days", "idle_days"])
    rows = rows.withColumnsRenamed({"days": "Total_Days", "idle_days": "Zero_Sales_Days"})
    rate = rnd(quotient(F.col("Zero_Sales_Days"), F.col("Total_Days")) * 100, 2)
    return (
        rows.withColumn("Dead_Stock_Rate_Percent", rate)
        .filter(F.col("Dead_Stock_Rate_Percent") > 0)
        .orderBy(F.desc("Dead_Stock_Rate_Percent"), "store_id", "product_id")
        .select(
            F.col("store_id").alias("Store_ID"), F.col("product_id").alias("Product_ID"),
            "Total_Days", "Zero_Sales_Days", "Dead_Stock_Rate_Percent",
        )
    )
