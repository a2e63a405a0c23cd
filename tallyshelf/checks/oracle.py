"""DuckDB SQL for every registered query, written independently of the Spark plans.

Each text stands alone: it derives the raw rows from the order tables, builds the star tables as
CTEs and ends in the report. Only the derivation of the raw rows is shared with Spark.
"""

from __future__ import annotations

from ..sources.tpch import RAW_SQL, TABLES, raw_sizes

RAW = RAW_SQL.format(**{name: name for name in TABLES}, **raw_sizes())

STAR = f"""
raw AS ({RAW}),
stores AS (
  SELECT DISTINCT Store_ID AS store_id, 'Store ' || Store_ID AS store_name
  FROM raw WHERE Store_ID IS NOT NULL
),
regions AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY region_name) AS INT) AS region_id, region_name
  FROM (SELECT DISTINCT Region AS region_name FROM raw WHERE Region <> '')
),
store_regions AS (
  SELECT DISTINCT raw.Store_ID AS store_id, regions.region_id
  FROM raw JOIN regions ON regions.region_name = raw.Region
  WHERE raw.Store_ID IS NOT NULL
),
products AS (
  SELECT Product_ID AS product_id, Category AS category,
         CAST(ROUND(CAST(CAST(SUM(Price) AS DOUBLE) / COUNT(*) AS DECIMAL(24,8)), 2) AS DECIMAL(10,2)) AS base_price
  FROM raw
  WHERE Product_ID IS NOT NULL AND Category IS NOT NULL AND Price IS NOT NULL
  GROUP BY Product_ID, Category
  QUALIFY ROW_NUMBER() OVER (PARTITION BY Product_ID ORDER BY Category) = 1
),
weather_conditions AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY weather_condition) AS INT) AS weather_id, weather_condition
  FROM (SELECT DISTINCT Weather_Condition AS weather_condition FROM raw WHERE Weather_Condition <> '')
),
seasonality AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY season_name) AS INT) AS season_id, season_name
  FROM (SELECT DISTINCT Seasonality AS season_name FROM raw WHERE Seasonality <> '')
),
promotions AS (
  SELECT * FROM (VALUES (1, FALSE, 'No Promotion'), (2, TRUE, 'Holiday Promotion'))
    AS t(promotion_id, is_holiday_promotion, promotion_description)
),
snap AS (
  SELECT Date AS snapshot_date, Store_ID AS store_id, regions.region_id, Product_ID AS product_id,
         Inventory_Level AS inventory_level, Units_Sold AS units_sold, Units_Ordered AS units_ordered,
         Demand_Forecast AS demand_forecast, Price AS current_price,
         Discount AS discount_percentage, Competitor_Pricing AS competitor_pricing,
         weather_conditions.weather_id, seasonality.season_id,
         IF(Holiday_Promotion = '1', 2, 1) AS promotion_id
  FROM raw
  JOIN regions ON regions.region_name = raw.Region
  LEFT JOIN weather_conditions ON weather_conditions.weather_condition = raw.Weather_Condition
  LEFT JOIN seasonality ON seasonality.season_name = raw.Seasonality
  WHERE Date IS NOT NULL AND Store_ID IS NOT NULL AND Product_ID IS NOT NULL
),
prices AS (
  SELECT DISTINCT Product_ID AS product_id, region_id, Date AS effective_date, Price AS price,
         Discount AS discount_percentage
  FROM raw JOIN regions ON regions.region_name = raw.Region
  WHERE Product_ID IS NOT NULL AND Date IS NOT NULL AND Price IS NOT NULL
),
-- every snapshot once for each region of its store
spread AS (
  SELECT s.* EXCLUDE (region_id), regions.region_name AS region
  FROM snap AS s
  JOIN store_regions USING (store_id)
  JOIN regions ON regions.region_id = store_regions.region_id
),
-- every snapshot with the names of its own dimensions
facts AS (
  SELECT s.*, regions.region_name, products.category, seasonality.season_name
  FROM snap AS s
  JOIN regions USING (region_id)
  JOIN products USING (product_id)
  LEFT JOIN seasonality ON seasonality.season_id = s.season_id
)
"""


def rnd(value: str, places: int = 0) -> str:
    wide = "DECIMAL(28,10)" if places > 4 else "DECIMAL(24,8)"
    return f"CAST(ROUND(CAST({value} AS {wide}), {places}) AS DOUBLE)"


def over(top: str, bottom: str) -> str:
    return f"(CAST({top} AS DOUBLE) / NULLIF(CAST({bottom} AS DOUBLE), 0))"


def mean(value: str) -> str:
    return over(f"SUM({value})", f"COUNT({value})")


def with_star(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STAR, *ctes]) + "\n" + body


LATEST = """
newest AS (
  SELECT * FROM facts
  QUALIFY ROW_NUMBER() OVER (PARTITION BY store_id, region_id, product_id ORDER BY snapshot_date DESC) = 1
)"""


def _stats(where: str = "TRUE") -> str:
    return f"""
stats AS (
  SELECT store_id, region_id, product_id, COUNT(*) AS days,
         {mean('units_sold')} AS avg_sold, STDDEV_POP(units_sold) AS sd_sold
  FROM snap WHERE {where}
  GROUP BY ALL
)"""


def _current_stock() -> str:
    return with_star(
        """SELECT store_id, region_name, category, product_id, inventory_level AS Current_Stock,
                  current_price, units_sold AS Last_Sales
           FROM newest""",
        LATEST,
    )


def _reorder_points(only: str = "TRUE") -> str:
    points = """
points AS (
  SELECT newest.*, avg_sold, sd_sold, avg_sold * 7 AS demand, 1.5e0 * sd_sold * SQRT(7e0) AS safety
  FROM newest JOIN stats USING (store_id, region_id, product_id)
  WHERE days >= 7
)"""
    return with_star(
        f"""SELECT * FROM (
              SELECT store_id, region_name, category, product_id, inventory_level AS current_stock,
                     {rnd('avg_sold', 2)} AS avg_daily_sales, {rnd('demand', 2)} AS avg_weekly_sales,
                     {rnd('safety', 2)} AS safety_stock, {rnd('demand + safety')} AS reorder_point,
                     CASE WHEN inventory_level <= 0 THEN 'Out of Stock'
                          WHEN inventory_level < demand + safety THEN 'Below Reorder Point'
                          WHEN inventory_level < (demand + safety) * 1.2e0 THEN 'Near Reorder Point'
                          ELSE 'Adequate Stock' END AS stock_status,
                     {rnd(over('inventory_level', 'avg_sold'), 1)} AS days_of_supply
              FROM points)
            WHERE {only}""",
        LATEST, _stats("units_sold >= 0"), points,
    )


def _seasonal_reorder_points() -> str:
    factors = f"""
factors AS (
  SELECT a.product_id, a.region_id, a.season_name, a.season_mean / NULLIF(b.year_mean, 0) AS factor
  FROM (SELECT product_id, region_id, season_name, {mean('units_sold')} AS season_mean
        FROM facts WHERE season_name IS NOT NULL GROUP BY ALL) AS a
  JOIN (SELECT product_id, region_id, {mean('units_sold')} AS year_mean FROM facts GROUP BY ALL) AS b
    USING (product_id, region_id)
),
points AS (
  SELECT n.*, avg_sold, avg_sold * 7 + 1.5e0 * (sd_sold * 7) AS standard, COALESCE(factor, 1) AS factor
  FROM newest AS n
  JOIN stats USING (store_id, region_id, product_id)
  LEFT JOIN factors AS f
    ON f.product_id = n.product_id AND f.region_id = n.region_id AND f.season_name = n.season_name
)"""
    return with_star(
        f"""SELECT store_id, region_name, category, product_id, inventory_level AS current_stock,
                   {rnd('avg_sold', 2)} AS avg_daily_sales, {rnd('avg_sold * 7', 2)} AS avg_weekly_sales,
                   {rnd('standard')} AS standard_reorder_point, {rnd('factor', 8)} AS seasonal_factor,
                   {rnd('standard * factor')} AS seasonal_reorder_point, season_name AS current_season,
                   CASE WHEN inventory_level <= 0 THEN 'Out of Stock'
                        WHEN inventory_level < standard * factor THEN 'Below Seasonal Reorder Point'
                        WHEN inventory_level < standard * factor * 1.2e0 THEN 'Near Seasonal Reorder Point'
                        ELSE 'Adequate Stock' END AS stock_status,
                   {rnd(over('inventory_level', 'avg_sold * factor'), 1)} AS days_of_supply
            FROM points""",
        LATEST, _stats(), factors,
    )


def _monthly_turnover() -> str:
    return with_star(
        f"""SELECT YearMonth, store_id, region_name, product_id, category, sold AS Total_Units_Sold,
                   {rnd('level', 4)} AS Avg_Inventory_Level, {rnd('ratio', 2)} AS Inventory_Turnover_Ratio,
                   CASE WHEN {rnd('ratio', 2)} > 3 THEN 'High Turnover'
                        WHEN {rnd('ratio', 2)} > 1 THEN 'Moderate Turnover'
                        WHEN {rnd('ratio', 2)} > 0 THEN 'Low Turnover'
                        ELSE 'No Sales' END AS Turnover_Category,
                   {rnd(over('30', 'ratio'), 1)} AS Days_To_Sell_Inventory
            FROM (SELECT *, {over('sold', 'level')} AS ratio FROM months)""",
        f"""months AS (
              SELECT STRFTIME(snapshot_date, '%Y-%m') AS YearMonth, store_id, region_name, product_id,
                     category, CAST(SUM(units_sold) AS BIGINT) AS sold, {mean('inventory_level')} AS level
              FROM facts GROUP BY ALL)""",
    )


def _stockout_risk() -> str:
    return with_star(
        f"""SELECT store_id, region_name, category, product_id, low_inventory_days, total_days, risk_ratio,
                   CASE WHEN risk_ratio >= 0.75e0 THEN 'High Risk' WHEN risk_ratio >= 0.4e0 THEN 'Moderate Risk'
                        WHEN risk_ratio >= 0.2e0 THEN 'Low Risk' ELSE 'Safe' END AS risk_flag
            FROM (SELECT *, {rnd(over('low_inventory_days', 'total_days'), 2)} AS risk_ratio FROM counts)""",
        _stats(),
        f"""counts AS (
              SELECT store_id, region_name, category, product_id,
                     COUNT(*) FILTER (inventory_level <= {rnd('avg_sold * 7 + 1.5e0 * sd_sold * 7', 2)})
                       AS low_inventory_days,
                     COUNT(*) AS total_days
              FROM facts JOIN stats USING (store_id, region_id, product_id)
              GROUP BY ALL)""",
    )


def _inventory_age() -> str:
    return with_star(
        """SELECT a.store_id AS Store_ID, a.product_id AS Product_ID,
                  STRFTIME(a.grown, '%Y-%m-%d') AS Last_Replenishment_Date,
                  STRFTIME(b.latest, '%Y-%m-%d') AS Latest_Date,
                  CAST(DATE_DIFF('day', a.grown, b.latest) AS INT) AS Inventory_Age_Days
           FROM (SELECT store_id, product_id, MAX(snapshot_date) AS grown FROM steps
                 WHERE inventory_level * 10 > before * 12 GROUP BY ALL) AS a
           JOIN (SELECT store_id, product_id, MAX(snapshot_date) AS latest FROM snap GROUP BY ALL) AS b
             USING (store_id, product_id)""",
        """steps AS (
             SELECT *, LAG(inventory_level) OVER (
                         PARTITION BY store_id, product_id ORDER BY snapshot_date, region_name) AS before
             FROM facts)""",
    )


def _stockout_rate() -> str:
    return with_star(
        f"""SELECT region AS Store_Region, store_id AS Store_ID, category AS Product_Category,
                   product_id AS Product_ID, Stockout_Days, Total_Days,
                   {rnd('share * 100', 2)} AS Stockout_Rate_Percent,
                   CASE WHEN share >= 0.3e0 THEN 'High Risk' WHEN share >= 0.1e0 THEN 'Moderate Risk'
                        WHEN share > 0 THEN 'Low Risk' ELSE 'No Stockouts' END AS Risk_Category
            FROM (SELECT *, {over('Stockout_Days', 'Total_Days')} AS share FROM counts)""",
        """counts AS (
             SELECT region, store_id, category, product_id,
                    COUNT(*) FILTER (inventory_level = 0) AS Stockout_Days, COUNT(*) AS Total_Days
             FROM spread JOIN products USING (product_id) GROUP BY ALL)""",
    )


def _sell_through_region(source: str, region: str, outer: str | None = None) -> str:
    pct = rnd(f"{over('sold', 'sold + level')} * 100", 2)
    body = f"""SELECT Month, Region, sold AS Total_Units_Sold, level AS Weighted_Avg_Inventory,
                      {pct} AS Sell_Through_Rate_Percent
               FROM months"""
    return with_star(
        outer.format(body=body) if outer else body,
        f"""days AS (
              SELECT {region} AS Region, snapshot_date, SUM(units_sold) AS sold, SUM(inventory_level) AS level
              FROM {source} GROUP BY ALL)""",
        f"""months AS (
              SELECT STRFTIME(snapshot_date, '%Y-%m') AS Month, Region, CAST(SUM(sold) AS BIGINT) AS sold,
                     {rnd(mean('level'), 2)} AS level
              FROM days GROUP BY ALL)""",
    )


def _sell_through_store() -> str:
    pct = rnd(f"{over('sold', 'sold + level')} * 100", 2)
    return with_star(
        f"""SELECT Month, Region, Store_ID, sold AS Total_Units_Sold, level AS Ending_Inventory,
                   {pct} AS Sell_Through_Rate_Percent
            FROM (SELECT STRFTIME(snapshot_date, '%Y-%m') AS Month, region AS Region, store_id AS Store_ID,
                         CAST(SUM(units_sold) AS BIGINT) AS sold, MAX(inventory_level) AS level
                  FROM spread GROUP BY ALL)"""
    )


def _average_stock_level() -> str:
    return with_star(
        f"""SELECT store_id AS Store, store_name AS StoreName, category AS Category,
                   STRFTIME(snapshot_date, '%Y-%m') AS YearMonth,
                   {rnd(mean('inventory_level'), 2)} AS Avg_Stock_Level
            FROM facts JOIN stores USING (store_id)
            GROUP BY ALL"""
    )


def _dead_stock() -> str:
    return with_star(
        f"""SELECT * FROM (
              SELECT store_id AS Store_ID, product_id AS Product_ID, COUNT(*) AS Total_Days,
                     COUNT(*) FILTER (units_sold = 0) AS Zero_Sales_Days,
                     {rnd(over('COUNT(*) FILTER (units_sold = 0)', 'COUNT(*)') + ' * 100', 2)}
                       AS Dead_Stock_Rate_Percent
              FROM snap GROUP BY ALL)
            WHERE Dead_Stock_Rate_Percent > 0"""
    )


def _stock_adjustment() -> str:
    # week from the calendar: Mondays counted since the Monday of the week that holds 1 January
    week = """(DATE_DIFF('day', DATE_TRUNC('week', MAKE_DATE(YEAR(snapshot_date), 1, 1)), snapshot_date) // 7
               + IF(ISODOW(MAKE_DATE(YEAR(snapshot_date), 1, 1)) <= 4, 1, 0))"""
    return with_star(
        f"""SELECT store_id, product_id, category, inventory_level AS current_stock,
                   {rnd('weekly', 4)} AS avg_weekly_sales, {rnd('point')} AS reorder_point,
                   CASE WHEN inventory_level < point THEN 'Order More'
                        WHEN inventory_level > 2 * point THEN 'Reduce Stock' ELSE 'Hold Steady' END
                     AS adjustment_recommendation,
                   {rnd(over('inventory_level', 'weekly'), 1)} AS weeks_of_supply
            FROM last_rows
            JOIN (SELECT store_id, product_id, {mean('sold')} AS weekly,
                         {mean('sold')} + 1.5e0 * STDDEV_POP(sold) AS point
                  FROM weeks GROUP BY ALL) USING (store_id, product_id)""",
        f"""weeks AS (
              SELECT store_id, product_id, YEAR(snapshot_date) AS y, {week} AS w, SUM(units_sold) AS sold
              FROM snap GROUP BY ALL)""",
        """last_rows AS (
             SELECT * FROM facts
             QUALIFY RANK() OVER (PARTITION BY store_id, product_id ORDER BY snapshot_date DESC) = 1)""",
    )


def _supplier_inconsistency() -> str:
    return with_star(
        f"""SELECT *,
                   CASE WHEN stockout_rate > 0.17e0 THEN 'Frequent Stockouts'
                        WHEN order_stddev > {rnd('avg_units_ordered * 0.6e0', 4)} THEN 'Erratic Ordering'
                        WHEN sales_stddev > {rnd('avg_units_sold * 0.9e0', 4)} THEN 'Erratic Fulfillment'
                        ELSE 'Consistent' END AS inconsistency_flag
            FROM (SELECT store_id, product_id, region, COUNT(*) AS days_tracked,
                         COUNT(*) FILTER (inventory_level <= 80) AS low_stock_days,
                         {rnd(over('COUNT(*) FILTER (inventory_level <= 80)', 'COUNT(*)'), 2)} AS stockout_rate,
                         {rnd('STDDEV_POP(units_ordered)', 2)} AS order_stddev,
                         {rnd(mean('units_ordered'), 2)} AS avg_units_ordered,
                         {rnd('STDDEV_POP(units_sold)', 2)} AS sales_stddev,
                         {rnd(mean('units_sold'), 2)} AS avg_units_sold
                  FROM spread
                  WHERE snapshot_date >= (SELECT MAX(snapshot_date) - INTERVAL 3 MONTH FROM snap)
                  GROUP BY ALL)"""
    )


TRENDS = """
sales AS (
  SELECT store_id, product_id, YEAR(snapshot_date) AS y, MONTH(snapshot_date) AS m,
         CAST(SUM(units_sold) AS BIGINT) AS sold
  FROM snap GROUP BY ALL
),
-- the three months before, by joining months to months
earlier AS (
  SELECT a.store_id, a.product_id, a.y, a.m, a.sold, COUNT(b.sold) AS n, SUM(b.sold) AS total
  FROM sales AS a
  LEFT JOIN sales AS b
    ON b.store_id = a.store_id AND b.product_id = a.product_id
   AND (a.y - b.y) * 12 + (a.m - b.m) IN (1, 2, 3)
  GROUP BY ALL
),
trends AS (
  SELECT *, CASE WHEN n = 0 THEN NULL WHEN sold * n * 10 > total * 11 THEN 'Upward'
                 WHEN sold * n * 10 < total * 9 THEN 'Downward' ELSE 'Stable' END AS trend
  FROM earlier
)"""


def _monthly_trend() -> str:
    return with_star(
        f"""SELECT store_id, product_id, CAST(m AS INT) AS Month, CAST(y AS INT) AS Year,
                   sold AS Total_Units_Sold, {rnd(over('total', 'n'), 4)} AS Prev3Month_Avg, trend AS Trend
            FROM trends""",
        TRENDS,
    )


def _demand_trend() -> str:
    return with_star(
        """SELECT store_id AS Store_ID, product_id AS Product_ID, CAST(m AS INT) AS Month,
                  up + down + flat AS Years_Tracked,
                  up AS Upward_Count, down AS Downward_Count, flat AS Stable_Count,
                  CASE WHEN up > down AND up > flat THEN 'Mostly Upward'
                       WHEN down > up AND down > flat THEN 'Mostly Downward'
                       WHEN flat > up AND flat > down THEN 'Mostly Stable' ELSE 'Mixed' END AS Avg_Trend
           FROM (SELECT store_id, product_id, m, COUNT(*) FILTER (trend = 'Upward') AS up,
                        COUNT(*) FILTER (trend = 'Downward') AS down,
                        COUNT(*) FILTER (trend = 'Stable') AS flat
                 FROM trends WHERE trend IS NOT NULL GROUP BY ALL)""",
        TRENDS,
    )


def _seasonal_demand() -> str:
    return with_star(
        f"""SELECT category, season_name, {rnd(mean('units_sold'), 4)} AS avg_units_sold
            FROM facts WHERE season_name IS NOT NULL GROUP BY ALL"""
    )


KPIS = f"""
kpis AS (
  SELECT store_id, STRFTIME(snapshot_date, '%Y-%m') AS month,
         {rnd(mean('inventory_level'), 2)} AS average_stock_level,
         {rnd(over('COUNT(*) FILTER (inventory_level = 0)', 'COUNT(*)'), 2)} AS stockout_rate,
         {rnd(over('SUM(units_sold)', mean('inventory_level')), 2)} AS inventory_turnover,
         {rnd(over('SUM(units_sold)', 'SUM(units_sold) + MAX(inventory_level)') + ' * 100', 2)} AS sell_through_rate
  FROM snap GROUP BY ALL
)"""


def _kpi_traffic_lights() -> str:
    rules = [
        ("average_stock_level", "v > 100", "v >= 70"), ("stockout_rate", "v < 0.1e0", "v <= 0.3e0"),
        ("inventory_turnover", "v > 2.5e0", "v >= 1.5e0"), ("sell_through_rate", "v > 70", "v >= 50"),
    ]
    parts = [
        f"""SELECT store_id, month, '{kpi}' AS kpi, v AS value,
                   CASE WHEN {green} THEN 'green' WHEN {yellow} THEN 'yellow' ELSE 'red' END AS light
            FROM (SELECT *, {kpi} AS v FROM kpis)"""
        for kpi, green, yellow in rules
    ]
    return with_star(" UNION ALL ".join(parts), KPIS)


BOARD = """
statuses AS (
  SELECT store_id, region_name AS region, CASE WHEN inventory_level = 0 THEN 'Out of Stock'
           WHEN inventory_level <= 10 THEN 'Below Reorder' WHEN inventory_level <= 20 THEN 'Near Reorder'
           ELSE 'Adequate Stock' END AS stock_status
  FROM facts WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM snap)
)"""
BOARD_COLUMNS = ["Out of Stock", "Below Reorder", "Near Reorder", "Adequate Stock"]
STORES = ["S001", "S002", "S003", "S004", "S005"]


def _status_pivot() -> str:
    cells = ", ".join(f"COUNT(*) FILTER (stock_status = '{s}') AS \"{s}\"" for s in BOARD_COLUMNS)
    return with_star(f"SELECT store_id, region, {cells} FROM statuses GROUP BY ALL", BOARD)


def _issue_heatmap() -> str:
    cells = ", ".join(
        f"COUNT(*) FILTER (store_id = '{s}' AND stock_status <> 'Adequate Stock') AS {s}" for s in STORES
    )
    return with_star(f"SELECT region, {cells} FROM statuses GROUP BY ALL", BOARD)


WORST = """
worst AS (
  SELECT product_id, store_id,
         CAST(MIN(CASE WHEN inventory_level = 0 THEN 0 WHEN inventory_level < units_ordered / 2 THEN 1
                       WHEN inventory_level < units_ordered THEN 2 ELSE 3 END) AS INT) AS Status_Code
  FROM snap GROUP BY ALL
)"""


def _product_store_matrix() -> str:
    cells = ", ".join(f"MIN(Status_Code) FILTER (store_id = '{s}') AS {s}" for s in STORES)
    return with_star(f"SELECT product_id, {cells} FROM worst GROUP BY ALL", WORST)


def _dims_incremental() -> str:
    """Dimensions after loading the first half of the days and then the rest."""
    mean_price = (
        "CAST(ROUND(CAST(CAST(SUM(Price) AS DOUBLE) / COUNT(*) AS DECIMAL(24,8)), 2) AS DECIMAL(10,2))"
    )

    def names(dim: str, column: str) -> str:
        return f"""
          SELECT '{dim}' AS dimension, name, CAST(ROW_NUMBER() OVER (ORDER BY part, name) AS INT) AS id,
                 NULL::DECIMAL(10,2) AS base_price
          FROM (SELECT {column} AS name, MIN(part) AS part FROM parts WHERE {column} <> '' GROUP BY 1)"""

    return with_star(
        f"""SELECT 'stores' AS dimension, Store_ID AS name, NULL::INT AS id, NULL::DECIMAL(10,2) AS base_price
            FROM parts GROUP BY Store_ID
            UNION ALL {names('regions', 'Region')}
            UNION ALL {names('weather_conditions', 'Weather_Condition')}
            UNION ALL {names('seasonality', 'Seasonality')}
            UNION ALL
            SELECT 'products', Product_ID || ' ' || Category, NULL::INT, base_price
            FROM (SELECT Product_ID, Category, part, {mean_price} AS base_price
                  FROM parts GROUP BY Product_ID, Category, part
                  QUALIFY ROW_NUMBER() OVER (PARTITION BY Product_ID ORDER BY part, Category) = 1)""",
        """parts AS (
             SELECT *, IF(Date <= (SELECT MIN(Date) + CAST((MAX(Date) - MIN(Date)) // 2 AS INT) FROM raw), 1, 2) AS part
             FROM raw)""",
    )


def _integrity() -> str:
    from ..schema import NOT_NULL, REFERENCES, UNIQUE

    source = {"inventory_snapshots": "snap", "price_history": "prices"}
    parts: list[str] = []
    for table, keys in UNIQUE.items():
        view = source.get(table, table)
        for cols in keys:
            listed = ", ".join(cols)
            parts.append(
                f"""SELECT '{table}' AS table_name, 'unique({listed})' AS rule, COUNT(*) AS checked,
                           COUNT(*) FILTER (n > 1) AS violations
                    FROM (SELECT {listed}, COUNT(*) AS n FROM {view} GROUP BY ALL)"""
            )
        for col in NOT_NULL[table]:
            parts.append(
                f"SELECT '{table}', 'not null({col})', COUNT(*), COUNT(*) - COUNT({col}) FROM {view}"
            )
        for col, parent in REFERENCES.get(table, {}).items():
            parts.append(
                f"""SELECT '{table}', 'references({col})', COUNT({col}),
                           COUNT({col}) FILTER ({col} NOT IN (SELECT {col} FROM {parent})) FROM {view}"""
            )
    return with_star("\nUNION ALL ".join(parts))


def _snapshots_with_names() -> str:
    return with_star(
        """SELECT snapshot_date, store_id, region_name, product_id, inventory_level, units_sold, units_ordered,
                  current_price, weather_condition, season_name, promotion_id
           FROM facts LEFT JOIN weather_conditions USING (weather_id)"""
    )


def _star_rejects() -> str:
    cells = ", ".join(
        f"COALESCE(CAST({c} AS VARCHAR), {null})" for c, null in (
            ("Date", "''"), ("Store_ID", "''"), ("Product_ID", "''"), ("Category", "''"), ("Region", "''"),
            ("Inventory_Level", "''"), ("Units_Sold", "''"), ("Units_Ordered", "''"), ("Demand_Forecast", "''"),
            ("Price", "''"), ("Discount", "''"), ("Weather_Condition", "''"), ("Holiday_Promotion", "''"),
            ("Competitor_Pricing", "''"), ("Seasonality", "CASE WHEN d = 13 THEN '\\N' ELSE '' END"),
        )
    )
    return f"""
      SELECT CONCAT_WS(',', {cells}) AS line,
             CASE d WHEN 13 THEN 'unreadable value' WHEN 17 THEN 'null key' ELSE 'unknown region' END AS reason,
             TRUE AS origin_known
      FROM (
        SELECT * REPLACE (
                 CASE WHEN DAY(Date) = 13 THEN 'n/a' ELSE CAST(Units_Sold AS VARCHAR) END AS Units_Sold,
                 CASE WHEN DAY(Date) <> 17 THEN Store_ID END AS Store_ID,
                 CASE WHEN DAY(Date) = 19 THEN '' ELSE Region END AS Region),
               DAY(Date) AS d
        FROM ({RAW}))
      WHERE d IN (13, 17, 19)"""


def oracle_sql() -> dict[str, str]:
    def table(name: str) -> str:
        return with_star(f"SELECT * FROM {name}")

    direct = _sell_through_region("facts", "region_name")
    return {
        "raw_import": f"SELECT * FROM ({RAW})",
        "raw_csv_round_trip": f"SELECT * FROM ({RAW})",
        "load_rejects": f"""
          SELECT 'unreadable value' AS reason, CAST(0 AS BIGINT) AS rows
          UNION ALL
          SELECT 'null key', COUNT(*) FILTER (Store_ID IS NULL OR Product_ID IS NULL OR Date IS NULL) FROM ({RAW})
          UNION ALL
          SELECT 'unknown region', COUNT(*) FILTER (
            Store_ID IS NOT NULL AND Product_ID IS NOT NULL AND Date IS NOT NULL AND (Region IS NULL OR Region = ''))
          FROM ({RAW})""",
        "dim_stores": table("stores"),
        "dim_regions": table("regions"),
        "bridge_store_regions": table("store_regions"),
        "dim_products": table("products"),
        "dim_weather": table("weather_conditions"),
        "dim_seasons": table("seasonality"),
        "snapshot_promotions": with_star(
            """SELECT snapshot_date, store_id, region_id, product_id, promotion_id, is_holiday_promotion,
                      promotion_description
               FROM snap JOIN promotions USING (promotion_id)"""
        ),
        "fact_snapshots": table("snap"),
        "price_history": table("prices"),
        "dims_incremental": _dims_incremental(),
        "star_incremental": _snapshots_with_names(),
        "star_compacted": _snapshots_with_names(),
        "star_rejects": _star_rejects(),
        "integrity_violations": _integrity(),
        "current_stock": _current_stock(),
        "reorder_points": _reorder_points(),
        "low_stock_alerts": _reorder_points("stock_status IN ('Out of Stock', 'Below Reorder Point')"),
        "seasonal_reorder_points": _seasonal_reorder_points(),
        "monthly_turnover": _monthly_turnover(),
        "stockout_risk": _stockout_risk(),
        "inventory_age": _inventory_age(),
        "stockout_rate": _stockout_rate(),
        "sell_through_region_month": _sell_through_region("spread", "region"),
        "sell_through_region_direct": direct,
        "clean_region_month": _sell_through_region(
            "facts", "region_name",
            """SELECT * REPLACE (TRIM(Region) AS Region, CAST(TRY_STRPTIME(Month, '%Y-%m') AS DATE) AS Month)
               FROM ({body}) WHERE TRY_STRPTIME(Month, '%Y-%m') IS NOT NULL""",
        ),
        "sell_through_store_month": _sell_through_store(),
        "average_stock_level": _average_stock_level(),
        "dead_stock": _dead_stock(),
        "stock_adjustment": _stock_adjustment(),
        "supplier_inconsistency": _supplier_inconsistency(),
        "monthly_trend": _monthly_trend(),
        "demand_trend": _demand_trend(),
        "monthly_kpis": with_star("SELECT * FROM kpis", KPIS),
        "kpi_traffic_lights": _kpi_traffic_lights(),
        "kpi_last3": with_star(
            "SELECT * FROM kpis WHERE month IN (SELECT DISTINCT month FROM kpis ORDER BY month DESC LIMIT 3)",
            KPIS,
        ),
        "seasonal_demand": _seasonal_demand(),
        "product_store_status": with_star("SELECT * FROM worst", WORST),
        "product_store_matrix": _product_store_matrix(),
        "product_store_map": with_star(
            """SELECT product_id, STRING_AGG(store_id || '=' || Status_Code, ',' ORDER BY store_id) AS Status_By_Store
               FROM worst GROUP BY product_id""", WORST
        ),
        "status_counts": with_star(
            "SELECT store_id, region, stock_status, COUNT(*) AS product_count FROM statuses GROUP BY ALL", BOARD
        ),
        "status_pivot": _status_pivot(),
        "issue_heatmap": _issue_heatmap(),
        "issue_map": with_star(
            """SELECT region, STRING_AGG(store_id || '=' || issues, ',' ORDER BY store_id) AS Issues_By_Store
               FROM (SELECT region, store_id, COUNT(*) FILTER (stock_status <> 'Adequate Stock') AS issues
                     FROM statuses GROUP BY ALL) GROUP BY region""", BOARD
        ),
    }
