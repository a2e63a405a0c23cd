"""Stock on hand: current levels, reorder points, average level and adjustment advice."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    ADJUSTMENT_LABELS, LEAD_DAYS, MIN_OBSERVATIONS, NEAR_FACTOR, REDUCE_FACTOR, REORDER_STATUS,
    SAFETY_Z, SEASONAL_STATUS,
)
from ..functions import (
    label_ladder, mean_of, moment_names, moment_sums, moments, month_label, pop_sd, quotient, rnd, week_of_year,
)
from ..operators import with_region_name
from ..operators.regions import with_products
from ..schema import SERIES
from .rollup import measured, month_of

Dims = Mapping[str, DataFrame]


def safety_days(lead_days: int, horizon: str) -> float:
    """Days of deviation kept as safety stock: the lead time or its square root."""
    return {"sqrt": math.sqrt(lead_days), "linear": float(lead_days)}[horizon]


def named(df: DataFrame, dims: Dims) -> DataFrame:
    """Region name and category for rows already reduced to series grain.

    Stores are not joined: only their id is printed, and the load checked that each one exists.
    """
    return with_products(with_region_name(df, dims), dims)


def current_stock(snap: DataFrame, dims: Dims) -> DataFrame:
    """Latest row of every (store, region, product)."""
    latest = measured(snap, SERIES, ["last_level", "last_price", "last_sold"])
    return (
        named(latest, dims)
        .select(
            "store_id", "region_name", "category", "product_id",
            F.col("last_level").alias("Current_Stock"), F.col("last_price").alias("current_price"),
            F.col("last_sold").alias("Last_Sales"),
        )
        .orderBy("store_id", "region_name", "category", "product_id")
    )


def _status_rank(stock: Column, point: Column, near: float) -> Column:
    return F.when(stock <= 0, 1).when(stock < point, 2).when(stock < point * near, 3).otherwise(4)


def _status_label(rank: Column, labels: Sequence[str]) -> Column:
    return label_ladder(rank, [("=", i, text) for i, text in enumerate(labels[:-1], 1)], labels[-1])


def reorder_points(
    snap: DataFrame, dims: Dims, *, lead_days: int = LEAD_DAYS, z: float = SAFETY_Z,
    near: float = NEAR_FACTOR, min_obs: int = MIN_OBSERVATIONS, horizon: str = "sqrt",
) -> DataFrame:
    """Stock against lead-time demand plus safety stock; series with enough observations only.

    The status compares with the unrounded reorder point.
    """
    stats = measured(snap, SERIES, ["last_level", *moment_names("sale")]).filter(F.col("sale_n") >= min_obs)
    stats = stats.select(
        *SERIES, F.col("last_level").alias("current_stock"), mean_of("sale").alias("avg_sold"), pop_sd("sale").alias("sd_sold")
    )
    demand = F.col("avg_sold") * lead_days
    safety = F.lit(z) * F.col("sd_sold") * safety_days(lead_days, horizon)
    rows = stats.withColumn("point", demand + safety).withColumn(
        "rank", _status_rank(F.col("current_stock"), F.col("point"), near)
    )
    return (
        named(rows, dims)
        .orderBy("rank", "store_id", "region_name", "product_id")
        .select(
            "store_id", "region_name", "category", "product_id", "current_stock",
            rnd(F.col("avg_sold"), 2).alias("avg_daily_sales"),
            rnd(demand, 2).alias("avg_weekly_sales"),
            rnd(safety, 2).alias("safety_stock"),
            rnd(F.col("point")).alias("reorder_point"),
            _status_label(F.col("rank"), REORDER_STATUS).alias("stock_status"),
            F.when(
                F.col("avg_sold") > 0, rnd(quotient(F.col("current_stock"), F.col("avg_sold")), 1)
            ).alias("days_of_supply"),
        )
    )


def low_stock_alerts(reorder: DataFrame) -> DataFrame:
    """Rows of ``reorder_points`` that are out of stock or below their reorder point."""
    return reorder.filter(F.col("stock_status").isin(REORDER_STATUS[:2]))


def seasonal_stats(snap: DataFrame) -> DataFrame:
    """Latest stock and season of every series, its sales statistics, and the factor of that season.

    The factor is a season's average sales over the all-year average, per product and region, days
    without a season included in the year. The fact is read once and reduced to a row per series and
    season; both averages are window sums over those rows, which then merge to their series.
    """
    cells = snap.groupBy(*SERIES, "season_id").agg(
        F.max("snapshot_date").alias("last"),
        F.max_by("inventory_level", "snapshot_date").alias("level"),
        *moment_sums(F.col("units_sold"), "sold"),
    )
    year = Window.partitionBy("product_id", "region_id")
    season = Window.partitionBy("product_id", "region_id", "season_id")

    def average(window) -> Column:
        return quotient(F.sum("sold_sum").over(window), F.sum("sold_n").over(window))

    factor = F.when(F.col("season_id").isNotNull(), quotient(F.col("season_mean"), F.col("year_mean")))
    cells = cells.withColumn("year_mean", average(year)).withColumn("season_mean", average(season))
    merged = cells.withColumn("factor", factor).groupBy(*SERIES).agg(
        F.max_by("level", "last").alias("current_stock"),
        F.max_by("season_id", "last").alias("season_id"),
        F.max_by("factor", "last").alias("factor"),
        *[F.sum(c).alias(c) for c in moment_names("sold")],
    )
    return merged.select(
        *SERIES, "current_stock", "season_id", "factor",
        mean_of("sold").alias("avg_sold"), pop_sd("sold").alias("sd_sold"),
    )


def seasonal_reorder_points(
    snap: DataFrame, dims: Dims, *, lead_days: int = LEAD_DAYS, z: float = SAFETY_Z,
    near: float = NEAR_FACTOR, horizon: str = "linear",
) -> DataFrame:
    """Reorder points scaled by the factor of the season the latest row is in; 1 without season."""
    rows = seasonal_stats(snap).join(dims["seasonality"], "season_id", "left")
    avg, demand = F.col("avg_sold"), F.col("avg_sold") * lead_days
    safety = F.lit(z) * (F.col("sd_sold") * safety_days(lead_days, horizon))
    rows = (
        rows.withColumn("factor", F.coalesce("factor", F.lit(1.0)))
        .withColumn("standard", demand + safety)
        .withColumn("point", F.col("standard") * F.col("factor"))
        .withColumn("rank", _status_rank(F.col("current_stock"), F.col("point"), near))
        .withColumn(
            "days_of_supply",
            rnd(quotient(F.col("current_stock"), avg * F.col("factor")), 1),
        )
    )
    return (
        named(rows, dims)
        .orderBy("rank", "store_id", "region_name", "days_of_supply", "product_id")
        .select(
            "store_id", "region_name", "category", "product_id", "current_stock",
            rnd(avg, 2).alias("avg_daily_sales"),
            rnd(demand, 2).alias("avg_weekly_sales"),
            rnd(F.col("standard")).alias("standard_reorder_point"),
            rnd(F.col("factor"), 8).alias("seasonal_factor"),
            rnd(F.col("point")).alias("seasonal_reorder_point"),
            F.col("season_name").alias("current_season"),
            _status_label(F.col("rank"), SEASONAL_STATUS).alias("stock_status"),
            "days_of_supply",
        )
    )


def average_stock_level(snap: DataFrame, dims: Dims) -> DataFrame:
    """Mean inventory per store, category and month.

    Products are summed up before their category is looked up, so the lookup never sees the fact.
    """
    products = measured(snap, ["store_id", "product_id", month_of(snap)], ["level_sum", "level_n"])
    rows = with_products(products, dims).groupBy("store_id", "category", "month").agg(
        F.sum("level_sum").alias("level_sum"), F.sum("level_n").alias("level_n")
    )
    return (
        rows.join(dims["stores"], "store_id")
        .orderBy("store_id", "category", "month")
        .select(
            F.col("store_id").alias("Store"),
            F.col("store_name").alias("StoreName"),
            F.col("category").alias("Category"),
            month_label(F.col("month")).alias("YearMonth"),
            rnd(mean_of("level"), 2).alias("Avg_Stock_Level"),
        )
    )


def stock_adjustment(
    snap: DataFrame, dims: Dims, *, z: float = SAFETY_Z, reduce_factor: float = REDUCE_FACTOR,
) -> DataFrame:
    """Latest stock of a store's product against its weekly sales, over the full history.

    The fact is read once and reduced to a cell per store, product, region and week. Totals of a week,
    their moments and the newest day are window sums over the cells, which one shuffle brings together.

    Every region present on the latest day gives a row; regions are not printed, so rows may repeat.
    """
    pair, day = ["store_id", "product_id"], F.col("snapshot_date")
    cells = snap.groupBy(*pair, "region_id", F.year(day).alias("year"), week_of_year(day).alias("week")).agg(
        F.sum("units_sold").alias("part_sold"), F.max("snapshot_date").alias("last"),
        F.max_by("inventory_level", "snapshot_date").alias("current_stock"),
    )
    week, whole = Window.partitionBy(*pair, "year", "week"), Window.partitionBy(*pair)
    cells = cells.repartition(*pair)  # serves both windows
    # a week's total counts once, on the cell of its first region
    first = F.row_number().over(week.orderBy("region_id")) == 1
    cells = cells.withColumn("sold", F.when(first, F.sum("part_sold").over(week)))
    sums = [m.over(whole).alias(name) for m, name in zip(moments(F.col("sold")), moment_names("sold"))]
    latest = cells.select("*", F.max("last").over(whole).alias("newest"), *sums).filter(F.col("last") == F.col("newest"))
    rows = latest.select(
        *pair, "region_id", "current_stock",
        mean_of("sold").alias("weekly"), F.coalesce(pop_sd("sold"), F.lit(0.0)).alias("sd"),
    )
    stock, point = F.col("current_stock"), F.col("weekly") + F.lit(z) * F.col("sd")
    order_more, reduce_stock, hold = ADJUSTMENT_LABELS
    advice = (
        F.when(stock < point, order_more).when(stock > reduce_factor * point, reduce_stock).otherwise(hold)
    )
    return (
        with_products(rows, dims)
        .withColumn("adjustment_recommendation", advice)
        .withColumn("weeks_of_supply", rnd(quotient(stock, F.col("weekly")), 1))
        .orderBy("adjustment_recommendation", "weeks_of_supply", "store_id", "product_id", "region_id")
        .select(
            "store_id", "product_id", "category", "current_stock",
            rnd(F.col("weekly"), 4).alias("avg_weekly_sales"),
            rnd(point).alias("reorder_point"),
            "adjustment_recommendation",
            "weeks_of_supply",
        )
    )
