"""From raw rows to the star schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HOLIDAY_FLAG, PROMOTIONS
from ..operators import insert_if_absent, numbered
from ..schema import RAW, STAR
from ..sources.raw_csv import BLOCK, CORRUPT, FILE


def _named(column: str):
    return F.col(column).isNotNull() & (F.col(column) != "")


def dim_stores(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("Store_ID").isNotNull()).select(
        F.col("Store_ID").alias("store_id"),
        F.concat(F.lit("Store "), "Store_ID").alias("store_name"),
    ).distinct()


def region_names(raw: DataFrame) -> DataFrame:
    return raw.filter(_named("Region")).select(F.col("Region").alias("region_name")).distinct()


def dim_regions(raw: DataFrame) -> DataFrame:
    return numbered(region_names(raw), "region_name", "region_id")


def bridge_store_regions(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region a store was seen in. Pairs are made distinct before the names are looked up."""
    pairs = raw.filter(F.col("Store_ID").isNotNull() & F.col("Region").isNotNull()).select(
        F.col("Store_ID").alias("store_id"), F.col("Region").alias("region_name")
    ).distinct()
    return pairs.join(regions, "region_name").select("store_id", "region_id")


def dim_products(raw: DataFrame) -> DataFrame:
    """One row per product; if it appears under several categories the smallest one is kept."""
    known = (
        F.col("Product_ID").isNotNull() & F.col("Category").isNotNull() & F.col("Price").isNotNull()
    )
    prices = raw.filter(known).groupBy("Product_ID", "Category").agg(
        F.sum("Price").alias("total"), F.count("Price").alias("n")
    )
    mean = F.col("row.total").cast("double") / F.col("row.n")
    return (
        prices.groupBy("Product_ID")
        .agg(F.min(F.struct("Category", "total", "n")).alias("row"))
        .select(
            F.col("Product_ID").alias("product_id"),
            F.col("row.Category").alias("category"),
            F.round(mean.cast("decimal(24,8)"), 2).cast("decimal(10,2)").alias("base_price"),
        )
    )


def weather_names(raw: DataFrame) -> DataFrame:
    return raw.filter(_named("Weather_Condition")).select(
        F.col("Weather_Condition").alias("weather_condition")
    ).distinct()


def dim_weather(raw: DataFrame) -> DataFrame:
    return numbered(weather_names(raw), "weather_condition", "weather_id")


def season_names(raw: DataFrame) -> DataFrame:
    return raw.filter(_named("Seasonality")).select(
        F.col("Seasonality").alias("season_name")
    ).distinct()


def dim_seasons(raw: DataFrame) -> DataFrame:
    return numbered(season_names(raw), "season_name", "season_id")


def dim_promotions(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*map(F.lit, row)).cast(f"struct<{STAR['promotions']}>") for row in PROMOTIONS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def fact_snapshots(raw: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Raw rows with their surrogate keys; rows without store, region, product or date drop out.

    The lookups carry no broadcast hint: loaded dimensions are files of known size, so Spark
    broadcasts them below its limit and sort-merge joins them beyond.
    """
    keyed = raw.filter(
        F.col("Store_ID").isNotNull() & F.col("Product_ID").isNotNull()
        & F.col("Date").isNotNull() & F.col("Region").isNotNull()
    )
    weather = dims["weather_conditions"].withColumnRenamed("weather_condition", "Weather_Condition")
    return (
        keyed.join(dims["regions"].withColumnRenamed("region_name", "Region"), "Region")
        .join(weather, "Weather_Condition", "left")
        .join(dims["seasonality"].withColumnRenamed("season_name", "Seasonality"), "Seasonality", "left")
        .select(
            F.col("Date").alias("snapshot_date"),
            F.col("Store_ID").alias("store_id"),
            "region_id",
            F.col("Product_ID").alias("product_id"),
            F.col("Inventory_Level").alias("inventory_level"),
            F.col("Units_Sold").alias("units_sold"),
            F.col("Units_Ordered").alias("units_ordered"),
            F.col("Demand_Forecast").alias("demand_forecast"),
            F.col("Price").alias("current_price"),
            F.col("Discount").alias("discount_percentage"),
            F.col("Competitor_Pricing").alias("competitor_pricing"),
            "weather_id",
            "season_id",
            F.when(F.col("Holiday_Promotion") == HOLIDAY_FLAG, 2).otherwise(1).alias("promotion_id"),
        )
    )


def price_history(raw: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct prices; duplicates go before the lookup, which sees fewer rows."""
    prices = raw.filter(
        F.col("Product_ID").isNotNull() & F.col("Date").isNotNull()
        & F.col("Price").isNotNull() & F.col("Region").isNotNull()
    ).select(
        F.col("Product_ID").alias("product_id"),
        F.col("Region").alias("region_name"),
        F.col("Date").alias("effective_date"),
        F.col("Price").alias("price"),
        F.col("Discount").alias("discount_percentage"),
    ).distinct()
    return prices.join(regions, "region_name").select(
        "product_id", "region_id", "effective_date", "price", "discount_percentage"
    )


def seen_names(raw: DataFrame) -> DataFrame:
    """Distinct texts the small dimensions are made of, from one narrow scan."""
    return raw.select("Store_ID", "Region", "Weather_Condition", "Seasonality").distinct()


#: Dimensions of numbered names: table -> (source column, id, name).
NUMBERED = {
    "regions": ("Region", "region_id", "region_name"),
    "weather_conditions": ("Weather_Condition", "weather_id", "weather_condition"),
    "seasonality": ("Seasonality", "season_id", "season_name"),
}


def _stacked(seen: DataFrame) -> DataFrame:
    """(dimension, name) of every named text of the numbered dimensions."""
    pairs = [F.struct(F.lit(table).alias("dimension"), F.col(c).alias("name")) for table, (c, _, _) in NUMBERED.items()]
    return seen.select(F.inline(F.array(*pairs))).filter(_named("name")).distinct()


def _unstacked(ids: DataFrame) -> dict[str, DataFrame]:
    return {
        table: ids.filter(F.col("dimension") == table).select(F.col("id").alias(ident), F.col("name").alias(name))
        for table, (_, ident, name) in NUMBERED.items()
    }


def _kept(df: DataFrame, name: str) -> DataFrame:
    return df


def build_dimensions(raw: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _kept) -> dict[str, DataFrame]:
    """All dimensions of one batch of raw rows.

    ``keep`` is given what several dimensions are made of, the seen names and their numbers; a load
    writes them out (``cut_lineage``), else they are computed for each dimension.
    """
    seen = keep(seen_names(raw), "seen")
    named = _unstacked(keep(numbered(_stacked(seen), "name", "id", within="dimension"), "ids"))
    return {
        "stores": dim_stores(seen),
        "regions": named["regions"],
        "store_regions": bridge_store_regions(seen, named["regions"]),
        "products": dim_products(raw),
        "weather_conditions": named["weather_conditions"],
        "seasonality": named["seasonality"],
        "promotions": dim_promotions(raw.sparkSession),
    }


def grow_dimensions(
    dims: Mapping[str, DataFrame], raw: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _kept
) -> dict[str, DataFrame]:
    """Dimensions after one more batch: known keys keep their row and id, new keys are added."""
    seen = keep(seen_names(raw), "seen")
    known = reduce(DataFrame.unionByName, [
        dims[table].select(F.lit(table).alias("dimension"), F.col(name).alias("name"), F.col(ident).alias("id"))
        for table, (_, ident, name) in NUMBERED.items()
    ])
    fresh = _stacked(seen).join(known.select("dimension", "name"), ["dimension", "name"], "left_anti")
    last = known.groupBy("dimension").agg(F.max("id").alias("last"))
    added = _unstacked(keep(numbered(fresh, "name", "id", last, "dimension"), "ids"))
    named = {table: dims[table].unionByName(added[table]) for table in NUMBERED}
    return {
        "stores": insert_if_absent(dims["stores"], dim_stores(seen), ["store_id"]),
        "regions": named["regions"],
        "store_regions": insert_if_absent(
            dims["store_regions"], bridge_store_regions(seen, named["regions"]), ["store_id", "region_id"]
        ),
        "products": insert_if_absent(dims["products"], dim_products(raw), ["product_id"]),
        "weather_conditions": named["weather_conditions"],
        "seasonality": named["seasonality"],
        "promotions": dims["promotions"],
    }


MONTH, PRICE_MONTH = "snapshot_month", "price_month"

UNREADABLE, NULL_KEY, NO_REGION = REASONS = ("unreadable value", "null key", "unknown region")


def reject_reason(raw: DataFrame) -> Column:
    """Why a raw row gives no snapshot; NULL if it gives one."""
    unread = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    no_key = F.col("Store_ID").isNull() | F.col("Product_ID").isNull() | F.col("Date").isNull()
    return F.when(unread, UNREADABLE).when(no_key, NULL_KEY).when(~F.coalesce(_named("Region"), F.lit(False)), NO_REGION)


def rejects(raw: DataFrame) -> DataFrame:
    """Raw rows that give no snapshot: the line as it was, or its columns joined, the reason and where it stood.

    ``file`` and ``block`` name the input file and the first byte of the block that a task read the
    line from; they are NULL for rows that no file was read for.
    """
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RAW.names])
    if CORRUPT in raw.columns:
        line = F.coalesce(F.col(CORRUPT), line)
    file = F.col(FILE) if FILE in raw.columns else F.lit(None).cast("string")
    block = F.col(BLOCK) if BLOCK in raw.columns else F.lit(None).cast("bigint")
    return raw.select(
        line.alias("line"), reject_reason(raw).alias("reason"), file.alias("file"), block.alias("block")
    ).filter("reason IS NOT NULL")


def reject_counts(raw: DataFrame) -> DataFrame:
    """Rows rejected for each reason, 0 included, from one pass."""
    reason = reject_reason(raw)
    counts = raw.agg(*[F.count_if(reason == r).alias(r) for r in REASONS])
    return counts.unpivot([], list(REASONS), "reason", "rows")
