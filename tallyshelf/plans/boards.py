"""Frames behind the dashboards: KPIs with lights, status counts and matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BOARD_BELOW, BOARD_NEAR, BOARD_STATUS, KPI_BOUNDS, LIGHTS
from ..functions import label_ladder, mean_of, month_label, quotient, rnd
from ..operators import pivot_fixed, with_region_name
from .load import MONTH
from .rollup import measured, month_of
from .risk import last_day, since
from .turnover import sell_through

Dims = Mapping[str, DataFrame]


def monthly_kpis(snap: DataFrame) -> DataFrame:
    """Average stock, stockout share, turnover and sell-through of each store and month."""
    months = measured(
        snap, ["store_id", month_of(snap)], ["days", "empty_days", "level_sum", "level_n", "level_max", "sold_sum"]
    )
    return months.orderBy("store_id", "month").select(
        "store_id",
        month_label(F.col("month")).alias("month"),
        rnd(mean_of("level"), 2).alias("average_stock_level"),
        rnd(quotient(F.col("empty_days"), F.col("days")), 2).alias("stockout_rate"),
        rnd(quotient(F.col("sold_sum"), mean_of("level")), 2).alias("inventory_turnover"),
        sell_through(F.col("sold_sum"), F.col("level_max")).alias("sell_through_rate"),
    )


def _light(value: Column, green: float, yellow: float, good: str) -> Column:
    strict, loose = {"high": (">", ">="), "low": ("<", "<=")}[good]
    return label_ladder(value, [(strict, green, LIGHTS[0]), (loose, yellow, LIGHTS[1])], LIGHTS[2])


def kpi_traffic_lights(
    kpis: DataFrame, bounds: Mapping[str, tuple[float, float, str]] = KPI_BOUNDS,
) -> DataFrame:
    """One row per store, month and KPI with its light; missing values are red, unknown KPIs gray."""
    names = [c for c in kpis.columns if c not in ("store_id", "month")]
    light = F.lit(LIGHTS[3])
    for kpi, rule in bounds.items():
        light = F.when(F.col("kpi") == kpi, _light(F.col("value"), *rule)).otherwise(light)
    return (
        kpis.unpivot(["store_id", "month"], names, "kpi", "value")
        .select("store_id", "month", "kpi", "value", light.alias("light"))
    )


def last_months(snap: DataFrame, n: int = 3, month_table: DataFrame | None = None) -> DataFrame:
    """Snapshots of the last ``n`` months that occur.

    With the month table of a load, only the folders of those months are opened.
    """
    if month_table is None:
        seen = snap.select(F.trunc("snapshot_date", "MM").alias("month")).distinct()
    else:
        seen = month_table.select(F.col(MONTH).alias("month"))
    newest = seen.orderBy(F.desc("month")).limit(n)
    return since(snap, newest.agg(F.min("month")).scalar())


def product_store_status(snap: DataFrame) -> DataFrame:
    """Worst status a product ever had in a store: 0 out of stock … 3 adequate."""
    level, ordered = F.col("inventory_level").cast("bigint"), F.col("units_ordered")
    code = F.when(level == 0, 0).when(level * 2 < ordered, 1).when(level < ordered, 2).otherwise(3)
    return snap.groupBy("product_id", "store_id").agg(F.min(code).alias("Status_Code"))


def product_store_matrix(status: DataFrame, stores: Sequence[str]) -> DataFrame:
    """``product_store_status`` with a column for each of ``stores``, which the caller names."""
    return pivot_fixed(status, ["product_id"], "store_id", stores, "Status_Code").orderBy("product_id")


def product_store_map(status: DataFrame) -> DataFrame:
    """``product_store_status`` as one map per product, store to code, for any number of stores."""
    cells = F.sort_array(F.collect_list(F.struct("store_id", "Status_Code")))
    return status.groupBy("product_id").agg(F.map_from_entries(cells).alias("Status_By_Store"))


def status_counts(
    snap: DataFrame, dims: Dims, *, below: int = BOARD_BELOW, near: int = BOARD_NEAR,
    month_table: DataFrame | None = None,
) -> DataFrame:
    """Products per status, store and region on the newest day."""
    out, low, close, fine = BOARD_STATUS
    status = label_ladder(
        F.col("inventory_level"), [("=", 0, out), ("<=", below, low), ("<=", near, close)], fine
    )
    counts = (
        since(snap, last_day(snap, month_table))
        .groupBy("store_id", "region_id", status.alias("stock_status"))
        .agg(F.count("product_id").alias("product_count"))
    )
    return (
        with_region_name(counts, dims)
        .orderBy("store_id", "region_name", "stock_status")
        .select("store_id", F.col("region_name").alias("region"), "stock_status", "product_count")
    )


def status_pivot(counts: DataFrame) -> DataFrame:
    """``status_counts`` with a column per status, 0 where there is none."""
    wide = pivot_fixed(counts, ["store_id", "region"], "stock_status", BOARD_STATUS, "product_count", 0)
    return wide.orderBy("store_id", "region")


def _issues(pivot: DataFrame) -> DataFrame:
    issues = sum((F.col(f"`{s}`") for s in BOARD_STATUS[1:3]), F.col(f"`{BOARD_STATUS[0]}`"))
    return pivot.select("region", "store_id", issues.alias("Total_Issues"))


def issue_map(pivot: DataFrame) -> DataFrame:
    """``issue_heatmap`` as one map per region, store to issues, for any number of stores."""
    cells = F.sort_array(F.collect_list(F.struct("store_id", "Total_Issues")))
    return _issues(pivot).groupBy("region").agg(F.map_from_entries(cells).alias("Issues_By_Store"))


def issue_heatmap(pivot: DataFrame, stores: Sequence[str]) -> DataFrame:
    """Products not in adequate stock: regions as rows, stores as columns, 0 where there is none."""
    return pivot_fixed(_issues(pivot), ["region"], "store_id", stores, "Total_Issues", 0).orderBy("region")
