import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import bag, day, rows
from pyspark.sql import functions as F

from tallyshelf import plans as P
from tallyshelf.operators import latest_with_ties


def history(start, levels, **rest):
    return [
        {"Date": day(start) + dt.timedelta(days=i), "Inventory_Level": v, **rest} for i, v in enumerate(levels)
    ]


def sales(start, sold, **rest):
    return [
        {"Date": day(start) + dt.timedelta(days=i), "Units_Sold": v, **rest} for i, v in enumerate(sold)
    ]


def test_current_stock_takes_the_latest_day(star_of):
    snap, dims = star_of(history("2000-01-01", [5, 6, 7]) + history("2000-01-01", [1], Region="South"))
    got = rows(P.current_stock(snap, dims))
    assert [(r["region_name"], r["Current_Stock"]) for r in got] == [("North", 7), ("South", 1)]


@pytest.mark.parametrize("days, shown", [(6, 0), (7, 1), (8, 1)])
def test_reorder_points_need_seven_days(star_of, days, shown):
    snap, dims = star_of(sales("2000-01-01", [1] * days))
    assert P.reorder_points(snap, dims).count() == shown


@pytest.mark.parametrize("stock, status", [
    (0, "Out of Stock"), (-1, "Out of Stock"), (69, "Below Reorder Point"), (70, "Near Reorder Point"),
    (83, "Near Reorder Point"), (84, "Adequate Stock"),
])
def test_reorder_status_edges(star_of, stock, status):
    snap, dims = star_of(sales("2000-01-01", [10] * 8, Inventory_Level=stock))
    got = rows(P.reorder_points(snap, dims))[0]
    assert got["stock_status"] == status and got["reorder_point"] == 70.0 and got["safety_stock"] == 0.0


def test_reorder_points_without_sales(star_of):
    snap, dims = star_of(sales("2000-01-01", [0] * 8))
    got = rows(P.reorder_points(snap, dims))[0]
    assert got["days_of_supply"] is None and got["stock_status"] == "Adequate Stock"


def test_negative_sales_do_not_count(star_of):
    snap, dims = star_of(sales("2000-01-01", [2] * 7 + [-9]))
    got = rows(P.reorder_points(snap, dims))[0]
    assert got["avg_daily_sales"] == 2.0
    assert P.reorder_points(snap, dims, min_obs=8).count() == 0


def test_low_stock_alerts(star_of):
    snap, dims = star_of([
        r for p, stock in (("P1", 0), ("P2", 69), ("P3", 70))
        for r in sales("2000-01-01", [10] * 8, Product_ID=p, Inventory_Level=stock)
    ])
    got = rows(P.low_stock_alerts(P.reorder_points(snap, dims)))
    assert [r["product_id"] for r in got] == ["P1", "P2"]


def test_seasonal_factor(star_of):
    # winter sells 30, the year 20 on average
    snap, dims = star_of(
        sales("2000-01-01", [30] * 4, Seasonality="Winter") + sales("2000-06-01", [10] * 4, Seasonality="Summer")
        + sales("2000-12-01", [20], Seasonality="Winter", Inventory_Level=500)
    )
    got = rows(P.seasonal_reorder_points(snap, dims))[0]
    assert got["current_season"] == "Winter"
    assert got["seasonal_factor"] == pytest.approx((140 / 5) / 20, abs=1e-8)


def test_latest_row_without_season_has_factor_one(star_of):
    snap, dims = star_of(sales("2000-01-01", [5, 9]) + sales("2000-02-01", [4], Seasonality=None))
    got = rows(P.seasonal_reorder_points(snap, dims))[0]
    assert got["seasonal_factor"] == 1.0 and got["current_season"] is None
    assert got["standard_reorder_point"] == got["seasonal_reorder_point"]


def test_product_that_never_sells_has_factor_one(star_of):
    snap, dims = star_of(sales("2000-01-01", [0, 0]))
    got = rows(P.seasonal_reorder_points(snap, dims))[0]
    assert got["seasonal_factor"] == 1.0 and got["days_of_supply"] is None


@pytest.mark.parametrize("sold, level, label, days", [
    (301, 100, "High Turnover", 10.0), (300, 100, "Moderate Turnover", 10.0), (101, 100, "Moderate Turnover", 29.7),
    (100, 100, "Low Turnover", 30.0), (0, 100, "No Sales", None), (5, 0, "No Sales", None),
    (1, 1000, "No Sales", 30000.0),
])
def test_turnover_labels_use_the_rounded_ratio(star_of, sold, level, label, days):
    snap, dims = star_of([{"Units_Sold": sold, "Inventory_Level": level}])
    got = rows(P.monthly_turnover(snap, dims))[0]
    assert (got["Turnover_Category"], got["Days_To_Sell_Inventory"]) == (label, days)


def test_stockout_risk_counts_days_at_the_point(star_of):
    # constant sales of 10: the point is 70
    snap, dims = star_of([
        {"Date": day("2000-01-01") + dt.timedelta(days=i), "Units_Sold": 10, "Inventory_Level": v}
        for i, v in enumerate([70, 71, 70, 0])
    ])
    got = rows(P.stockout_risk(snap, dims))[0]
    assert (got["low_inventory_days"], got["total_days"], got["risk_ratio"], got["risk_flag"]) == (3, 4, 0.75, "High Risk")


@pytest.mark.parametrize("low, n, flag", [(2, 5, "Moderate Risk"), (1, 5, "Low Risk"), (0, 5, "Safe"), (39, 200, "Low Risk")])
def test_stockout_risk_flags(star_of, low, n, flag):
    snap, dims = star_of(history("2000-01-01", [0] * low + [1000] * (n - low), Units_Sold=10))
    assert rows(P.stockout_risk(snap, dims))[0]["risk_flag"] == flag


@pytest.mark.parametrize("empty, n, label", [
    (3, 10, "High Risk"), (1, 10, "Moderate Risk"), (1, 11, "Low Risk"), (0, 3, "No Stockouts"), (299, 1000, "Moderate Risk"),
])
def test_stockout_rate_labels_use_the_unrounded_share(star_of, empty, n, label):
    snap, dims = star_of(history("2000-01-01", [0] * empty + [9] * (n - empty)))
    assert rows(P.stockout_rate(snap, dims))[0]["Risk_Category"] == label


def two_regions():
    return (
        history("2000-01-01", [10, 20]) + history("2000-01-01", [30, 0], Region="South")
        + history("2000-01-01", [7], Store_ID="S2", Region="South")
    )


def test_regions_through_the_store_or_the_snapshot(star_of):
    snap, dims = star_of(two_regions())
    every = {(r["Store_Region"], r["Store_ID"]): r["Total_Days"] for r in rows(P.stockout_rate(snap, dims))}
    own = {(r["Store_Region"], r["Store_ID"]): r["Total_Days"] for r in rows(P.stockout_rate(snap, dims, region_via="snapshot"))}
    assert every == {("North", "S1"): 4, ("South", "S1"): 4, ("South", "S2"): 1}
    assert own == {("North", "S1"): 2, ("South", "S1"): 2, ("South", "S2"): 1}
    with pytest.raises(ValueError):
        P.stockout_rate(snap, dims, region_via="elsewhere")


def test_sell_through_region_fans_out_like_a_plain_join(star_of):
    snap, dims = star_of(two_regions())
    got = {r["Region"]: r for r in rows(P.sell_through_region_month(snap, dims))}
    assert got["North"]["Weighted_Avg_Inventory"] == 30.0  # (40 + 20) / 2
    assert got["South"]["Weighted_Avg_Inventory"] == 33.5  # (47 + 20) / 2
    assert got["South"]["Total_Units_Sold"] == 5
    own = {r["Region"]: r for r in rows(P.sell_through_region_month(snap, dims, region_via="snapshot"))}
    assert own["South"]["Weighted_Avg_Inventory"] == 18.5  # (37 + 0) / 2


def test_aggregating_before_the_fan_out_changes_nothing(star):
    joined = (
        star.snap.join(star.dims["store_regions"].withColumnRenamed("region_id", "other"), "store_id")
        .drop("region_id").withColumnRenamed("other", "region_id")
    )
    late = P.sell_through_region_month(star.snap, star.dims)
    early = P.sell_through_region_month(joined, star.dims, region_via="snapshot")
    assert bag(late) == bag(early)
    assert bag(P.stockout_rate(star.snap, star.dims)) == bag(P.stockout_rate(joined, star.dims, region_via="snapshot"))
    assert bag(P.supplier_inconsistency(star.snap, star.dims)) == bag(
        P.supplier_inconsistency(joined, star.dims, region_via="snapshot")
    )


def test_sell_through_store_month_uses_the_largest_inventory(star_of):
    snap, dims = star_of(two_regions())
    got = {(r["Region"], r["Store_ID"]): r for r in rows(P.sell_through_store_month(snap, dims))}
    assert set(got) == {("North", "S1"), ("South", "S1"), ("South", "S2")}
    assert got["North", "S1"]["Ending_Inventory"] == 30
    assert got["North", "S1"]["Sell_Through_Rate_Percent"] == pytest.approx(round(4 / 34 * 100, 2))


def test_sell_through_of_nothing_is_null(star_of):
    snap, dims = star_of([{"Inventory_Level": 0, "Units_Sold": 0}])
    assert rows(P.sell_through_store_month(snap, dims))[0]["Sell_Through_Rate_Percent"] is None


def test_inventory_age_needs_more_than_a_fifth(star_of):
    snap, _ = star_of(history("2000-01-01", [10, 12, 9, 8]))
    assert rows(P.inventory_age(snap)) == []
    snap, _ = star_of(history("2000-01-01", [10, 13, 9, 8]))
    got = rows(P.inventory_age(snap))[0]
    assert (got["Last_Replenishment_Date"], got["Latest_Date"], got["Inventory_Age_Days"]) == ("2000-01-02", "2000-01-04", 2)


def test_inventory_age_across_month_boundaries(star_of):
    # only the first row of March grows, against the last row of January: February has none
    snap, _ = star_of(history("2000-01-30", [9, 5]) + history("2000-03-01", [7, 6]))
    got = rows(P.inventory_age(snap))[0]
    assert got["Last_Replenishment_Date"] == "2000-03-01"


def test_inventory_age_equals_a_plain_walk(star_of):
    rng = random.Random(3)
    data = []
    for store in ("S1", "S2"):
        for product in ("P1", "P2", "P3"):
            for offset in sorted(rng.sample(range(400), 60)):
                for region in rng.sample(["A", "B", "C"], rng.randint(1, 3)):
                    data.append({
                        "Store_ID": store, "Product_ID": product, "Region": region,
                        "Date": day("1999-11-20") + dt.timedelta(days=offset), "Inventory_Level": rng.randint(0, 12),
                    })
    expected = {}
    ordered = sorted(data, key=lambda r: (r["Store_ID"], r["Product_ID"], r["Date"], r["Region"]))
    for before, now in zip(ordered, ordered[1:]):
        key = now["Store_ID"], now["Product_ID"]
        if (before["Store_ID"], before["Product_ID"]) == key and now["Inventory_Level"] * 10 > before["Inventory_Level"] * 12:
            expected[key] = now["Date"].isoformat()
    snap, _ = star_of(data)
    got = {(r["Store_ID"], r["Product_ID"]): r["Last_Replenishment_Date"] for r in rows(P.inventory_age(snap))}
    assert got == expected


def test_dead_stock_hides_what_rounds_to_zero(star_of):
    snap, _ = star_of(sales("2000-01-01", [0, 1, 1]) + sales("2000-01-01", [1, 1], Product_ID="P2"))
    got = rows(P.dead_stock(snap))
    assert [(r["Product_ID"], r["Dead_Stock_Rate_Percent"]) for r in got] == [("P1", 33.33)]


def test_average_stock_level_weighs_products_by_days(star_of):
    snap, dims = star_of(history("2000-01-01", [10, 20]) + history("2000-01-01", [40], Product_ID="P2"))
    got = rows(P.average_stock_level(snap, dims))
    assert [(r["StoreName"], r["YearMonth"], r["Avg_Stock_Level"]) for r in got] == [("Store S1", "2000-01", 23.33)]


def test_stock_adjustment_keeps_every_region_of_the_last_day(star_of):
    snap, dims = star_of(
        history("2000-01-03", [5, 5, 9]) + history("2000-01-05", [1], Region="South")
        + history("2000-01-04", [77], Region="West")
    )
    got = rows(P.stock_adjustment(snap, dims))
    assert sorted(r["current_stock"] for r in got) == [1, 9]


@pytest.mark.parametrize("stock, advice", [(9, "Order More"), (10, "Hold Steady"), (20, "Hold Steady"), (21, "Reduce Stock")])
def test_stock_adjustment_edges(star_of, stock, advice):
    # one sale of 10 in each of two weeks
    snap, dims = star_of([
        {"Date": day("2000-01-03"), "Units_Sold": 10}, {"Date": day("2000-01-10"), "Units_Sold": 10, "Inventory_Level": stock},
    ])
    got = rows(P.stock_adjustment(snap, dims))[0]
    assert (got["adjustment_recommendation"], got["reorder_point"]) == (advice, 10.0)


def test_weeks_split_at_new_year(star_of):
    # Monday 1997-12-29 to Friday 1998-01-02 is one ISO week, but week 53 and week 1 here
    snap, dims = star_of([
        {"Date": day("1997-12-30"), "Units_Sold": 10}, {"Date": day("1998-01-02"), "Units_Sold": 20},
    ])
    assert rows(P.stock_adjustment(snap, dims))[0]["avg_weekly_sales"] == 15.0


def test_supplier_window_is_clamped_and_inclusive(star_of):
    snap, dims = star_of([{"Date": day(d)} for d in ("2001-02-27", "2001-02-28", "2001-03-01", "2001-05-31")])
    assert rows(P.supplier_inconsistency(snap, dims))[0]["days_tracked"] == 3


@pytest.mark.parametrize("case, flag", [
    (dict(Inventory_Level=[80, 99, 99, 99, 99], Units_Ordered=[5] * 5, Units_Sold=[5] * 5), "Frequent Stockouts"),
    (dict(Inventory_Level=[81] * 5, Units_Ordered=[0, 0, 0, 0, 9], Units_Sold=[5] * 5), "Erratic Ordering"),
    (dict(Inventory_Level=[81] * 5, Units_Ordered=[5] * 5, Units_Sold=[0, 0, 0, 0, 9]), "Erratic Fulfillment"),
    (dict(Inventory_Level=[81] * 4, Units_Ordered=[1, 1, 4, 4], Units_Sold=[1, 1, 19, 19]), "Consistent"),
])
def test_supplier_flags(star_of, case, flag):
    snap, dims = star_of([
        {"Date": day("2000-01-01") + dt.timedelta(days=i), **dict(zip(case, values))}
        for i, values in enumerate(zip(*case.values()))
    ])
    assert rows(P.supplier_inconsistency(snap, dims))[0]["inconsistency_flag"] == flag


def test_trend_looks_back_three_calendar_months(star_of):
    snap, _ = star_of([
        {"Date": day(d), "Units_Sold": s}
        for d, s in (("2000-11-05", 10), ("2000-12-05", 20), ("2001-03-05", 22), ("2001-07-05", 5), ("2001-08-05", 6))
    ])
    got = [(r["Year"], r["Month"], r["Prev3Month_Avg"], r["Trend"]) for r in rows(P.monthly_trend(snap))]
    assert got == [
        (2000, 11, None, None), (2000, 12, 10.0, "Upward"), (2001, 3, 20.0, "Stable"), (2001, 7, None, None),
        (2001, 8, 5.0, "Upward"),
    ]


def test_trend_is_exact_at_its_bounds(star_of):
    # 15 is nine tenths of 50 / 3 exactly
    snap, _ = star_of([
        {"Date": day(f"2000-0{m}-01"), "Units_Sold": s} for m, s in ((1, 10), (2, 20), (3, 20), (4, 15))
    ])
    assert rows(P.monthly_trend(snap))[-1]["Trend"] == "Stable"


def test_demand_trend_needs_a_strict_majority(star_of):
    snap, _ = star_of([
        {"Date": day(f"{y}-{m:02d}-01"), "Units_Sold": s}
        for y, a, b in ((2000, 10, 20), (2001, 20, 10), (2002, 10, 20)) for m, s in ((1, a), (2, b))
    ])
    got = {r["Month"]: r for r in rows(P.demand_trend(snap))}
    assert (got[2]["Upward_Count"], got[2]["Downward_Count"], got[2]["Avg_Trend"]) == (2, 1, "Mostly Upward")
    snap, _ = star_of([
        {"Date": day(f"{y}-{m:02d}-01"), "Units_Sold": s}
        for y, a, b in ((2000, 10, 20), (2001, 20, 10)) for m, s in ((1, a), (2, b))
    ])
    assert rows(P.demand_trend(snap))[0]["Avg_Trend"] == "Mixed"


def test_seasonal_demand_skips_days_without_season(star_of):
    snap, dims = star_of(sales("2000-01-01", [1, 2]) + sales("2000-01-01", [4], Product_ID="P2") + sales("2000-02-01", [99], Seasonality=""))
    assert rows(P.seasonal_demand(snap, dims)) == [{"category": "C1", "season_name": "Winter", "avg_units_sold": 2.3333}]


KPI_EDGES = [
    ("average_stock_level", [(100.01, "green"), (100.0, "yellow"), (70.0, "yellow"), (69.99, "red"), (None, "red")]),
    ("stockout_rate", [(0.09, "green"), (0.1, "yellow"), (0.3, "yellow"), (0.31, "red"), (None, "red")]),
    ("inventory_turnover", [(2.51, "green"), (2.5, "yellow"), (1.5, "yellow"), (1.49, "red"), (None, "red")]),
    ("sell_through_rate", [(70.01, "green"), (70.0, "yellow"), (50.0, "yellow"), (49.99, "red"), (None, "red")]),
    ("something_else", [(1.0, "gray")]),
]


@pytest.mark.parametrize("kpi, cases", KPI_EDGES)
def test_traffic_lights(spark, kpi, cases):
    frame = spark.createDataFrame([(f"S{i}", "2000-01", v) for i, (v, _) in enumerate(cases)], f"store_id string, month string, {kpi} double")
    got = rows(P.kpi_traffic_lights(frame).orderBy("store_id"))
    assert [r["light"] for r in got] == [light for _, light in cases]


def test_kpis_of_the_last_months(star_of):
    snap, _ = star_of([
        {"Date": day(d), "Store_ID": s} for d, s in (("2000-01-01", "S1"), ("2000-03-01", "S1"), ("2000-04-01", "S2"), ("2000-07-01", "S1"))
    ])
    got = P.monthly_kpis(P.last_months(snap, 3))
    assert [(r["store_id"], r["month"]) for r in rows(got)] == [("S1", "2000-03"), ("S1", "2000-07"), ("S2", "2000-04")]


def test_worst_status_per_product_and_store(star_of):
    cases = {"P0": (0, 9), "P1": (4, 9), "P2": (5, 9), "P3": (9, 9), "P4": (3, 6)}
    snap, dims = star_of([
        {"Product_ID": p, "Inventory_Level": level, "Units_Ordered": ordered} for p, (level, ordered) in cases.items()
    ] + [{"Product_ID": "P0", "Date": day("2000-02-01"), "Inventory_Level": 99}])
    status = P.product_store_status(snap)
    assert {r["product_id"]: r["Status_Code"] for r in rows(status)} == {"P0": 0, "P1": 1, "P2": 2, "P3": 3, "P4": 2}
    wide = rows(P.product_store_matrix(status, ["S1", "S2"]))
    assert wide[0] == {"product_id": "P0", "S1": 0, "S2": None}


def test_status_board_of_the_last_day(star_of):
    levels = [0, 10, 11, 20, 21]
    snap, dims = star_of(
        [{"Product_ID": f"P{i}", "Inventory_Level": v} for i, v in enumerate(levels)]
        + [{"Date": day("1999-12-31"), "Product_ID": "P9", "Inventory_Level": 0}]
        + [{"Product_ID": "P1", "Store_ID": "S2", "Region": "South", "Inventory_Level": 5}]
    )
    counts = P.status_counts(snap, dims)
    assert {(r["store_id"], r["stock_status"]): r["product_count"] for r in rows(counts)} == {
        ("S1", "Out of Stock"): 1, ("S1", "Below Reorder"): 1, ("S1", "Near Reorder"): 2, ("S1", "Adequate Stock"): 1,
        ("S2", "Below Reorder"): 1,
    }
    pivot = P.status_pivot(counts)
    assert rows(pivot)[1] == {
        "store_id": "S2", "region": "South", "Out of Stock": 0, "Below Reorder": 1, "Near Reorder": 0, "Adequate Stock": 0,
    }
    assert rows(P.issue_heatmap(pivot, ["S1", "S2"])) == [
        {"region": "North", "S1": 4, "S2": 0}, {"region": "South", "S1": 0, "S2": 1},
    ]


def test_latest_with_ties_equals_the_join_form(star):
    got = latest_with_ties(star.snap, ["store_id", "product_id"], ["region_id"], "snapshot_date", {"level": "inventory_level"})
    newest = star.snap.groupBy("store_id", "product_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    joined = star.snap.join(newest, ["store_id", "product_id", "snapshot_date"]).select(
        "store_id", "product_id", "region_id", F.col("inventory_level").alias("level")
    )
    assert bag(got) == bag(joined)
