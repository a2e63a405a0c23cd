"""Column contracts: the raw import, the star tables and their integrity rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order and types of the raw import and of the star tables.
RAW = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Store_ID", T.StringType()),
    T.StructField("Product_ID", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Inventory_Level", T.IntegerType()),
    T.StructField("Units_Sold", T.IntegerType()),
    T.StructField("Units_Ordered", T.IntegerType()),
    T.StructField("Demand_Forecast", T.DecimalType(10, 2)),
    T.StructField("Price", T.DecimalType(10, 2)),
    T.StructField("Discount", T.DecimalType(5, 2)),
    T.StructField("Weather_Condition", T.StringType()),
    T.StructField("Holiday_Promotion", T.StringType()),
    T.StructField("Competitor_Pricing", T.DecimalType(10, 2)),
    T.StructField("Seasonality", T.StringType()),
])

STAR = {
    "stores": "store_id string, store_name string",
    "regions": "region_id int, region_name string",
    "store_regions": "store_id string, region_id int",
    "products": "product_id string, category string, base_price decimal(10,2)",
    "weather_conditions": "weather_id int, weather_condition string",
    "seasonality": "season_id int, season_name string",
    "promotions": "promotion_id int, is_holiday_promotion boolean, promotion_description string",
    "inventory_snapshots": (
        "snapshot_date date, store_id string, region_id int, product_id string, "
        "inventory_level int, units_sold int, units_ordered int, "
        "demand_forecast decimal(10,2), current_price decimal(10,2), "
        "discount_percentage decimal(5,2), competitor_pricing decimal(10,2), "
        "weather_id int, season_id int, promotion_id int"
    ),
    "price_history": (
        "product_id string, region_id int, effective_date date, "
        "price decimal(10,2), discount_percentage decimal(5,2)"
    ),
}

DIMENSIONS = (
    "stores", "regions", "store_regions", "products",
    "weather_conditions", "seasonality", "promotions",
)

# Keys, mandatory columns and references each table must honour.
UNIQUE = {
    "stores": [["store_id"]],
    "regions": [["region_id"], ["region_name"]],
    "store_regions": [["store_id", "region_id"]],
    "products": [["product_id"]],
    "weather_conditions": [["weather_id"], ["weather_condition"]],
    "seasonality": [["season_id"], ["season_name"]],
    "promotions": [["promotion_id"]],
    "inventory_snapshots": [["snapshot_date", "store_id", "region_id", "product_id"]],
    "price_history": [],
}
NOT_NULL = {
    "stores": ["store_id"],
    "regions": ["region_id", "region_name"],
    "store_regions": ["store_id", "region_id"],
    "products": ["product_id", "category", "base_price"],
    "weather_conditions": ["weather_id", "weather_condition"],
    "seasonality": ["season_id", "season_name"],
    "promotions": ["promotion_id", "is_holiday_promotion"],
    "inventory_snapshots": [
        "snapshot_date", "store_id", "region_id", "product_id",
        "inventory_level", "units_sold", "units_ordered", "current_price",
    ],
    "price_history": ["product_id", "region_id", "effective_date", "price"],
}
REFERENCES = {
    "store_regions": {"store_id": "stores", "region_id": "regions"},
    "inventory_snapshots": {
        "store_id": "stores",
        "region_id": "regions",
        "product_id": "products",
        "weather_id": "weather_conditions",
        "season_id": "seasonality",
        "promotion_id": "promotions",
    },
    "price_history": {"product_id": "products", "region_id": "regions"},
}

# Natural key of the fact. It bounds every series (store, region, product) by one row per day.
SNAPSHOT_KEY = UNIQUE["inventory_snapshots"][0]
SERIES = ["store_id", "region_id", "product_id"]
