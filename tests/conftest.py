import datetime as dt
import os
import sys
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyshelf.plans import fact_snapshots  # noqa: E402
from tallyshelf.schema import RAW, STAR  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "Date": dt.date(2000, 1, 1), "Store_ID": "S1", "Product_ID": "P1", "Category": "C1", "Region": "North",
    "Inventory_Level": 10, "Units_Sold": 1, "Units_Ordered": 5, "Demand_Forecast": Decimal("1.00"),
    "Price": Decimal("10.00"), "Discount": Decimal("0.00"), "Weather_Condition": "Sunny",
    "Holiday_Promotion": "0", "Competitor_Pricing": Decimal("9.00"), "Seasonality": "Winter",
}


def day(text):
    return dt.date.fromisoformat(text)


def local(spark, records, schema):
    """A frame of dicts that Spark knows the size of."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(records, to_arrow_schema(schema)), schema)


@pytest.fixture(scope="session")
def raw_of(spark):
    """Raw rows from partial dicts; missing columns take a default."""
    return lambda records: local(spark, [{**DEFAULTS, **r} for r in records], RAW)


def dimensions(spark, records):
    """Dimensions of raw records, made in plain Python."""
    def ids(column):
        return {name: i for i, name in enumerate(sorted({r[column] for r in records if r[column]}), 1)}

    regions, weather, seasons = ids("Region"), ids("Weather_Condition"), ids("Seasonality")
    stores = sorted({r["Store_ID"] for r in records if r["Store_ID"]})
    pairs = sorted({(r["Store_ID"], regions[r["Region"]]) for r in records if r["Store_ID"] and r["Region"]})
    products = {r["Product_ID"]: r for r in records if r["Product_ID"]}
    content = {
        "stores": [(s, f"Store {s}") for s in stores],
        "regions": [(i, n) for n, i in regions.items()],
        "store_regions": pairs,
        "products": [(p, r["Category"], r["Price"]) for p, r in products.items()],
        "weather_conditions": [(i, n) for n, i in weather.items()],
        "seasonality": [(i, n) for n, i in seasons.items()],
        "promotions": [(1, False, "No Promotion"), (2, True, "Holiday Promotion")],
    }
    columns = {name: T.StructType.fromDDL(STAR[name]).names for name in content}
    return {
        name: local(spark, [dict(zip(columns[name], row)) for row in data], STAR[name])
        for name, data in content.items()
    }


@pytest.fixture(scope="session")
def star_of(spark, raw_of):
    """(snap, dims) of partial raw rows, for tests of the reports."""
    def build(records):
        dims = dimensions(spark, [{**DEFAULTS, **r} for r in records])
        return fact_snapshots(raw_of(records), dims), dims
    return build


@pytest.fixture(scope="session")
def star(spark):
    from tallyshelf import registry
    return registry.star_of(spark, SF)


def rows(df):
    return [r.asDict() for r in df.collect()]


def bag(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
