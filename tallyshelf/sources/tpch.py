"""Raw inventory rows derived from order lines, for inputs that hold no inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "supplier", "nation", "region", "part")

# The derivation. Integer and decimal arithmetic only, and only functions that Spark
# and DuckDB share, so the text gives the same rows in both.
RAW_SQL = """
WITH lines AS (
  SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey % {stores} AS st, l_partkey % {products} AS pk,
         r_name, r_regionkey, l_orderkey, l_linenumber, l_returnflag, l_discount, p_retailprice,
         CAST(l_quantity AS BIGINT) AS q
  FROM {lineitem}
  JOIN {supplier} ON l_suppkey = s_suppkey
  JOIN {nation} ON s_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey
  JOIN {part} ON l_partkey = p_partkey
), days AS (
  SELECT d, st, pk, r_name, r_regionkey,
         CAST(SUM(l_orderkey * 13 + l_linenumber * 37) AS BIGINT) AS h,
         CAST(SUM(CASE WHEN l_returnflag = 'R' AND pk % 8 <> 7 THEN 0 ELSE q END) AS INT) AS units_sold,
         CAST(SUM(q) + 40 * (pk % 4) AS INT) AS units_ordered,
         MAX(p_retailprice) AS price, MAX(l_discount) AS disc, MIN(l_linenumber) AS ln
  FROM lines
  GROUP BY d, st, pk, r_name, r_regionkey
)
SELECT d AS Date,
       CONCAT('S', LPAD(CAST(st + 1 AS STRING), {store_digits}, '0')) AS Store_ID,
       CONCAT('P', LPAD(CAST(pk + 1 AS STRING), {product_digits}, '0')) AS Product_ID,
       CONCAT('CAT', CAST(pk % 5 + 1 AS STRING)) AS Category,
       r_name AS Region,
       CAST(CASE WHEN pk % 4 = 3 THEN h % (100 + 45 * pk) + 1
                 ELSE GREATEST(h % (100 + 45 * pk) - 35, 0) END AS INT) AS Inventory_Level,
       units_sold AS Units_Sold,
       units_ordered AS Units_Ordered,
       CAST(units_sold * 1.10 AS DECIMAL(10,2)) AS Demand_Forecast,
       CAST(price AS DECIMAL(10,2)) AS Price,
       CAST(disc * 100 AS DECIMAL(5,2)) AS Discount,
       CASE (DAYOFYEAR(d) + r_regionkey) % 5 WHEN 0 THEN 'Sunny' WHEN 1 THEN 'Rainy'
            WHEN 2 THEN 'Cloudy' WHEN 3 THEN 'Snowy' ELSE '' END AS Weather_Condition,
       CASE WHEN MONTH(d) = 12 THEN '1' ELSE '0' END AS Holiday_Promotion,
       CAST(CAST(price AS DECIMAL(10,2)) - 5 + ln AS DECIMAL(10,2)) AS Competitor_Pricing,
       CASE WHEN DAYOFMONTH(d) = 31 THEN NULL WHEN MONTH(d) IN (12, 1, 2) THEN 'Winter'
            WHEN MONTH(d) IN (3, 4, 5) THEN 'Spring' WHEN MONTH(d) IN (6, 7, 8) THEN 'Summer'
            ELSE 'Autumn' END AS Seasonality
FROM days
"""


def table_paths(folder: str) -> list[str]:
    return [f"{folder.rstrip('/')}/{name}.parquet" for name in TABLES]


def raw_sizes(stores: int = 5, products: int = 20) -> dict[str, int]:
    """What ``RAW_SQL`` takes besides the tables: how many stores and products the lines are dealt to."""
    return {
        "stores": stores, "products": products,
        "store_digits": max(3, len(str(stores))), "product_digits": max(4, len(str(products))),
    }


def raw_from_orders(spark: SparkSession, folder: str, stores: int = 5, products: int = 20) -> DataFrame:
    """Raw rows from the order tables in ``folder``."""
    tables = {n: spark.read.parquet(p) for n, p in zip(TABLES, table_paths(folder))}
    return spark.sql(RAW_SQL, **tables, **raw_sizes(stores, products))
