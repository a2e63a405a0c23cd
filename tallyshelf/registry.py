"""Named queries over a folder of order tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans as P
from .operators import integrity_report, pivot_values
from .plans.star import Star
from .sources.raw_csv import NULL_TOKEN, read_raw_csv
from .sources.tables import cut_lineage, new_path, stamp
from .sources.tpch import raw_from_orders, table_paths

Query = Callable[[SparkSession, str], DataFrame]

_stars: dict[tuple, Star] = {}


def star_of(spark: SparkSession, folder: str) -> Star:
    """The star loaded from ``folder``, once per application and state of its files."""
    key = (spark.sparkContext.applicationId, folder, stamp(spark, table_paths(folder)))
    if key not in _stars:
        _stars[key] = P.load_star(spark, raw_from_orders(spark, folder))
    return _stars[key]


def _report(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, folder: build(star_of(spark, folder))


def dims_incremental(raw: DataFrame) -> DataFrame:
    """Dimensions after loading the first half of the days and then the rest, in one frame."""
    span = raw.agg(F.expr("date_add(min(Date), cast(floor(datediff(max(Date), min(Date)) / 2) AS int))"))
    middle = span.scalar()
    dims = P.build_dimensions(raw.filter(F.col("Date") <= middle), cut_lineage)
    dims = P.grow_dimensions(dims, raw.filter(F.col("Date") > middle), cut_lineage)

    def long(name: str, text, ident=None, price=None) -> DataFrame:
        none = F.lit(None)
        return dims[name].select(
            F.lit(name).alias("dimension"),
            text.alias("name"),
            (none if ident is None else F.col(ident)).cast("int").alias("id"),
            (none if price is None else F.col(price)).cast("decimal(10,2)").alias("base_price"),
        )

    return (
        long("stores", F.col("store_id"))
        .unionAll(long("regions", F.col("region_name"), "region_id"))
        .unionAll(long("weather_conditions", F.col("weather_condition"), "weather_id"))
        .unionAll(long("seasonality", F.col("season_name"), "season_id"))
        .unionAll(long("products", F.concat_ws(" ", "product_id", "category"), None, "base_price"))
    )


def snapshot_promotions(star: Star) -> DataFrame:
    """Every snapshot with the promotion it refers to."""
    return star.snap.join(star.dims["promotions"], "promotion_id").select(
        "snapshot_date", "store_id", "region_id", "product_id",
        "promotion_id", "is_holiday_promotion", "promotion_description",
    )


def _grown(raw: DataFrame, parts: int) -> str:
    """Where the days of ``raw`` were loaded: the first of ``parts`` equal spans, then the others appended."""
    spark, path = raw.sparkSession, new_path(raw.sparkSession, "grown")
    span = raw.agg(F.min("Date").alias("low"), F.expr("datediff(max(Date), min(Date))").alias("days")).first()
    cuts = [span.low + timedelta(days=span.days * i // parts) for i in range(1, parts)]
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        days = F.lit(True) if low is None else F.col("Date") > low
        days = days if high is None else days & (F.col("Date") <= high)
        load = P.append_star if i else P.load_star
        load(spark, path=path, raw=raw.filter(days), keep_stage=False)
    return path


def _with_names(star: Star) -> DataFrame:
    """Snapshots with the names of their dimensions, which do not depend on how ids were given."""
    return (
        star.snap.join(star.dims["regions"], "region_id")
        .join(star.dims["weather_conditions"], "weather_id", "left")
        .join(star.dims["seasonality"], "season_id", "left")
        .select(
            "snapshot_date", "store_id", "region_name", "product_id", "inventory_level", "units_sold", "units_ordered",
            "current_price", "weather_condition", "season_name", "promotion_id",
        )
    )


def star_incremental(raw: DataFrame) -> DataFrame:
    """Snapshots with their names after loading the first half of the days and appending the rest."""
    return _with_names(P.read_star(raw.sparkSession, _grown(raw, 2)))


def star_compacted(raw: DataFrame) -> DataFrame:
    """Snapshots with their names after a load and two appends were made one part and the old parts deleted."""
    spark, path = raw.sparkSession, _grown(raw, 3)
    P.compact_star(spark, path)
    P.vacuum_star(spark, path)
    return _with_names(P.read_star(spark, path))


def star_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of two CSV batches that gave no snapshot, with the reason and whether their file is known.

    Some values of the raw rows are spoilt on the way out: sales that are no number, missing stores,
    empty regions.
    """
    path = new_path(spark, "dirty")
    rows = raw_from_orders(spark, folder)
    day = F.dayofmonth("Date")
    texts = rows.withColumns({
        "Units_Sold": F.when(day == 13, "n/a").otherwise(F.col("Units_Sold").cast("string")),
        "Store_ID": F.when(day != 17, F.col("Store_ID")),
        "Region": F.when(day == 19, "").otherwise(F.col("Region")),
    })
    options = {"header": True, "nullValue": NULL_TOKEN, "emptyValue": ""}
    for half in (0, 1):
        texts.filter(F.year("Date") % 2 == half).write.options(**options).csv(f"{path}/csv{half}")
        load = P.append_star if half else P.load_star
        load(spark, path=f"{path}/star", raw=read_raw_csv(spark, f"{path}/csv{half}"), unreadable="set_aside", keep_stage=False)
    found = P.read_star(spark, f"{path}/star").rejects
    return found.select("line", "reason", F.col("file").isNotNull().alias("origin_known"))


def raw_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The raw rows written as CSV to the shared folder and read back."""
    path = new_path(spark, "csv")
    rows = raw_from_orders(spark, folder)
    rows.write.options(header=True, nullValue=NULL_TOKEN, emptyValue="").csv(path)
    return read_raw_csv(spark, path).select(*rows.columns)


def _map_text(column: str) -> Column:
    """A map as text, in the order of its entries."""
    cells = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.concat_ws(",", cells).alias(column)


def product_store_cells(star: Star) -> DataFrame:
    """The store map of each product as text, stores in order."""
    return P.product_store_map(P.product_store_status(star.snap)).select("product_id", _map_text("Status_By_Store"))


def _store_ids(star: Star) -> list[str]:
    return pivot_values(star.dims["stores"], "store_id")


def _status_counts(star: Star) -> DataFrame:
    return P.status_counts(star.snap, star.dims, month_table=star.months)


def queries() -> dict[str, Query]:
    return {
        "raw_import": raw_from_orders,
        "raw_csv_round_trip": raw_csv_round_trip,
        "load_rejects": _report(lambda s: P.reject_counts(s.raw)),
        "dim_stores": _report(lambda s: P.dim_stores(s.raw)),
        "dim_regions": _report(lambda s: P.dim_regions(s.raw)),
        "bridge_store_regions": _report(lambda s: P.bridge_store_regions(s.raw, s.dims["regions"])),
        "dim_products": _report(lambda s: P.dim_products(s.raw)),
        "dim_weather": _report(lambda s: P.dim_weather(s.raw)),
        "dim_seasons": _report(lambda s: P.dim_seasons(s.raw)),
        "snapshot_promotions": _report(snapshot_promotions),
        "fact_snapshots": _report(lambda s: P.fact_snapshots(s.raw, s.dims)),
        "price_history": _report(lambda s: P.price_history(s.raw, s.dims["regions"])),
        "dims_incremental": _report(lambda s: dims_incremental(s.raw)),
        "star_incremental": _report(lambda s: star_incremental(s.raw)),
        "star_compacted": _report(lambda s: star_compacted(s.raw)),
        "star_rejects": star_rejects,
        "integrity_violations": _report(lambda s: integrity_report(s.tables())),
        "current_stock": _report(lambda s: P.current_stock(s.rollup, s.dims)),
        "reorder_points": _report(lambda s: P.reorder_points(s.rollup, s.dims)),
        "low_stock_alerts": _report(lambda s: P.low_stock_alerts(P.reorder_points(s.rollup, s.dims))),
        "seasonal_reorder_points": _report(lambda s: P.seasonal_reorder_points(s.snap, s.dims)),
        "monthly_turnover": _report(lambda s: P.monthly_turnover(s.rollup, s.dims)),
        "stockout_risk": _report(lambda s: P.stockout_risk(s.snap, s.dims)),
        "inventory_age": _report(lambda s: P.inventory_age(s.snap, s.dims)),
        "stockout_rate": _report(lambda s: P.stockout_rate(s.rollup, s.dims)),
        "sell_through_region_month": _report(lambda s: P.sell_through_region_month(s.snap, s.dims)),
        "sell_through_region_direct": _report(
            lambda s: P.sell_through_region_month(s.snap, s.dims, region_via="snapshot")
        ),
        "clean_region_month": _report(
            lambda s: P.clean_region_month(
                P.sell_through_region_month(s.snap, s.dims, region_via="snapshot")
            )
        ),
        "sell_through_store_month": _report(lambda s: P.sell_through_store_month(s.rollup, s.dims)),
        "average_stock_level": _report(lambda s: P.average_stock_level(s.rollup, s.dims)),
        "dead_stock": _report(lambda s: P.dead_stock(s.rollup)),
        "stock_adjustment": _report(lambda s: P.stock_adjustment(s.snap, s.dims)),
        "supplier_inconsistency": _report(lambda s: P.supplier_inconsistency(s.snap, s.dims, month_table=s.months)),
        "monthly_trend": _report(lambda s: P.monthly_trend(s.rollup)),
        "demand_trend": _report(lambda s: P.demand_trend(s.rollup)),
        "monthly_kpis": _report(lambda s: P.monthly_kpis(s.rollup)),
        "kpi_traffic_lights": _report(lambda s: P.kpi_traffic_lights(P.monthly_kpis(s.rollup))),
        "kpi_last3": _report(lambda s: P.monthly_kpis(P.last_months(s.snap, 3, s.months))),
        "seasonal_demand": _report(lambda s: P.seasonal_demand(s.snap, s.dims)),
        "product_store_status": _report(lambda s: P.product_store_status(s.snap)),
        "product_store_matrix": _report(
            lambda s: P.product_store_matrix(P.product_store_status(s.snap), _store_ids(s))
        ),
        "product_store_map": _report(product_store_cells),
        "status_counts": _report(_status_counts),
        "status_pivot": _report(lambda s: P.status_pivot(_status_counts(s))),
        "issue_heatmap": _report(
            lambda s: P.issue_heatmap(P.status_pivot(_status_counts(s)), _store_ids(s))
        ),
        "issue_map": _report(
            lambda s: P.issue_map(P.status_pivot(_status_counts(s))).select("region", _map_text("Issues_By_Store"))
        ),
    }
