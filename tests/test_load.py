import pathlib

import pytest
from conftest import bag, day, rows
from decimal import Decimal
from pyspark.sql import functions as F

from tallyshelf import plans as P
from tallyshelf.operators import (
    IntegrityError, assert_integrity, check_fk, check_not_null, check_unique, insert_if_absent,
    integrity_report, numbered,
)
from tallyshelf.schema import RAW
from tallyshelf.sources import clean_text, normalize_keys, parse_month, read_raw_csv
from tallyshelf.sources.tables import new_path

HEADER = ",".join(RAW.names)


def csv(tmp_path, *lines, end="\n"):
    path = tmp_path / "raw.csv"
    path.write_bytes((end.join([HEADER, *lines]) + end).encode())
    return str(path)


def test_csv_reads_by_position(spark, tmp_path):
    path = csv(tmp_path, '2022-01-01,S001,P0001,"Toys, games",North,231,127,55,135.47,33.50,20,Rainy,0,29.69,Autumn')
    got = rows(read_raw_csv(spark, path))[0]
    assert got["Category"] == "Toys, games" and got["Date"] == day("2022-01-01")
    assert got["Demand_Forecast"] == Decimal("135.47") and got["Discount"] == Decimal("20.00")
    assert got["Inventory_Level"] == 231 and got["_corrupt_record"] is None


def test_csv_keeps_bad_values_as_null_with_the_line(spark, tmp_path):
    good = "2022-01-01,S001,P0001,Toys,North,1,2,3,1.00,2.00,3,Rainy,0,4.00,Winter"
    path = csv(
        tmp_path, good, good.replace(",1,2,3,", ",x,2,3,"), good.replace("2022-01-01", "01/02/2022"),
        "2022-01-01,S001", good.replace("North", "").replace("Rainy", "\\N"), end="\r\n",
    )
    got = rows(read_raw_csv(spark, path))
    assert [r["_corrupt_record"] is None for r in got] == [True, False, False, False, True]
    assert got[1]["Inventory_Level"] is None and got[1]["Units_Sold"] == 2
    assert got[2]["Date"] is None
    assert got[4]["Region"] == "" and got[4]["Weather_Condition"] is None
    assert got[0]["Seasonality"] == "Winter"


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    path = csv(tmp_path, '2022-01-01,S001,P0001,"two\nlines",North,1,2,3,1.00,2.00,3,Rainy,0,4.00,Winter')
    assert rows(read_raw_csv(spark, path, multi_line=True))[0]["Category"] == "two\nlines"


def test_clean_text_and_months(spark):
    df = spark.createDataFrame([(" a\x00b\t", "2024-01"), ("c", "2024-1"), ("d", "bad"), ("e", None)], "t string, m string")
    got = rows(parse_month(clean_text(df, ["t", "m"]), "m"))
    assert [(r["t"], r["m"]) for r in got] == [("ab", day("2024-01-01")), ("c", day("2024-01-01"))]


def test_normalize_keys(spark):
    df = normalize_keys(spark.createDataFrame([(" P1 ",)], "k string"), ["k"])
    assert df.first().k == "p1"


def test_empty_and_null_names_make_no_dimension_row(raw_of):
    raw = raw_of([
        {"Region": "South", "Weather_Condition": "", "Seasonality": None},
        {"Region": ""}, {"Region": None}, {"Store_ID": None}, {"Product_ID": None}, {"Date": None},
    ])
    dims = P.build_dimensions(raw)
    snap = P.fact_snapshots(raw, dims)
    assert [r["region_name"] for r in rows(dims["regions"].orderBy("region_id"))] == ["North", "South"]
    got = rows(snap)
    assert len(got) == 1 and got[0]["weather_id"] is None and got[0]["season_id"] is None


def test_holiday_promotion(spark, star_of):
    snap, _ = star_of([{"Holiday_Promotion": h, "Product_ID": f"P{i}"} for i, h in enumerate(["1", "0", "", None])])
    assert [r["promotion_id"] for r in rows(snap.orderBy("product_id"))] == [2, 1, 1, 1]
    assert rows(P.dim_promotions(spark).orderBy("promotion_id")) == [
        {"promotion_id": 1, "is_holiday_promotion": False, "promotion_description": "No Promotion"},
        {"promotion_id": 2, "is_holiday_promotion": True, "promotion_description": "Holiday Promotion"},
    ]


def test_product_under_two_categories_keeps_the_smallest(raw_of):
    raw = raw_of([
        {"Category": "B", "Price": Decimal("1.00")}, {"Category": "A", "Price": Decimal("10.00")},
        {"Category": "A", "Price": Decimal("10.01")}, {"Product_ID": "P2", "Price": None},
    ])
    got = rows(P.dim_products(raw))
    assert got == [{"product_id": "P1", "category": "A", "base_price": Decimal("10.01")}]  # 10.005 rounds up


def test_numbers_follow_the_order_over_many_partitions(spark):
    names = [f"n{i:05d}" for i in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
        got = rows(numbered(df, "name", "id").orderBy("id"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [(r["id"], r["name"]) for r in got] == list(enumerate(names, 1))


def test_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "a", 10), (7, "b", 20)], "id int, name string, v int")
    new = spark.createDataFrame([("b", 99), ("d", 2), ("c", 5), ("d", 1)], "name string, v int")
    once = insert_if_absent(target, new, ["name"], "id")
    assert bag(once.select("id", "name", "v")) == [(1, "a", 10), (7, "b", 20), (8, "c", 5), (9, "d", 1)]
    assert bag(insert_if_absent(once, new, ["name"], "id")) == bag(once)


def test_growing_dimensions_keeps_ids_and_prices(raw_of):
    first = raw_of([{"Region": "North"}, {"Region": "West"}])
    second = raw_of([{"Region": "East", "Price": Decimal("99.00")}, {"Region": "West", "Product_ID": "P2"}])
    dims = P.grow_dimensions(P.build_dimensions(first), second)
    regions = {r["region_name"]: r["region_id"] for r in rows(dims["regions"])}
    assert regions == {"North": 1, "West": 2, "East": 3}
    prices = {r["product_id"]: r["base_price"] for r in rows(dims["products"])}
    assert prices == {"P1": Decimal("10.00"), "P2": Decimal("10.00")}
    assert {r["region_id"] for r in rows(dims["store_regions"])} == {1, 2, 3}


def test_checks_find_each_kind_of_violation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, p string")
    parent = spark.createDataFrame([("a",)], "p string")
    assert rows(check_unique(df, ["k"])) == [{"k": 1, "copies": 2}]
    assert rows(check_not_null(df, ["k", "p"])) == [{"column_name": "k", "violations": 2}]
    assert {(r["p"], r["rows"]) for r in rows(check_fk(df, "p", parent))} == {("b", 1), ("c", 2)}


def test_dirty_star_is_reported_and_refused(star_of):
    snap, dims = star_of([{}, {}, {"Product_ID": "P2", "Inventory_Level": None}])
    stranger = snap.filter("product_id = 'P1'").limit(1).withColumn("store_id", F.lit("S9"))
    tables = {**dims, "inventory_snapshots": snap.unionByName(stranger)}
    broken = {(r["table_name"], r["rule"]): r["violations"] for r in rows(integrity_report(tables).filter("violations > 0"))}
    assert broken == {
        ("inventory_snapshots", "unique(snapshot_date, store_id, region_id, product_id)"): 1,
        ("inventory_snapshots", "not null(inventory_level)"): 1,
        ("inventory_snapshots", "references(store_id)"): 1,
    }
    with pytest.raises(IntegrityError, match="unique"):
        assert_integrity(tables)


def test_refused_load_publishes_nothing_and_can_be_repeated(spark, raw_of):
    path = new_path(spark, "refused")
    good = raw_of([{}])
    P.load_star(spark, good, path)
    with pytest.raises(IntegrityError):
        P.load_star(spark, raw_of([{}, {}]), path)
    assert P.read_star(spark, path).snap.count() == 1
    star = P.load_star(spark, raw_of([{}, {"Product_ID": "P2"}]), path)
    assert P.read_star(spark, path).snap.count() == 2
    star.drop_stage()
    assert P.read_star(spark, path).snap.count() == 2


def test_a_load_leaves_only_its_tables(spark, raw_of):
    path = new_path(spark, "clean")
    folder = pathlib.Path(path.removeprefix("file:").removeprefix("//")).parent
    folder.mkdir(parents=True, exist_ok=True)
    before = {p.name for p in folder.iterdir()}
    star = P.load_star(spark, raw_of([{}]), path, keep_stage=False)
    P.append_star(spark, path, raw_of([{"Date": day("2000-03-01"), "Region": "South"}]))
    assert {p.name for p in folder.iterdir()} - before == {pathlib.Path(path).name}
    assert star.snap.count() == 1 and P.read_star(spark, path).snap.count() == 2


def test_more_days_are_appended_to_a_star(spark, raw_of):
    path = new_path(spark, "more")
    P.load_star(spark, raw_of([{"Region": "North"}, {"Region": "West"}]), path)
    more = raw_of([{"Date": day("2000-02-01"), "Region": r} for r in ("East", "West")])
    P.append_star(spark, path, more)
    star = P.read_star(spark, path)
    assert star.snap.count() == 4 and star.prices.count() == 4
    assert {r["region_name"]: r["region_id"] for r in rows(star.dims["regions"])} == {"North": 1, "West": 2, "East": 3}
    assert sum(m["rows"] for m in rows(star.months)) == 4
    with pytest.raises(IntegrityError):
        P.append_star(spark, path, raw_of([{"Region": "West"}]))
    assert bag(P.read_star(spark, path).snap) == bag(star.snap)
    whole = P.load_star(spark, raw_of([{"Region": "North"}, {"Region": "West"}]).unionByName(more))
    assert whole.snap.count() == 4 and bag(whole.prices.select("effective_date", "price")) == bag(
        star.prices.select("effective_date", "price"))


def test_rows_that_give_no_snapshot_are_kept_with_the_reason(spark, tmp_path):
    good = "2022-01-01,S001,P0001,Toys,North,1,2,3,1.00,2.00,3,Rainy,0,4.00,Winter"
    bad = [good.replace("2022-01-01", "01/02/2022"), good.replace("North", ""), good.replace("P0001", "\\N")]
    raw = read_raw_csv(spark, csv(tmp_path, good, *bad))
    with pytest.raises(P.UnreadableError):
        P.load_star(spark, raw)
    star = P.load_star(spark, raw, unreadable="set_aside")
    assert star.snap.count() == 1
    assert sorted(r["reason"] for r in rows(star.rejects)) == ["null key", "unknown region", "unreadable value"]
    assert {r["line"] for r in rows(star.rejects.filter("reason = 'unreadable value'"))} == {bad[0]}
    counts = {r["reason"]: r["rows"] for r in rows(P.reject_counts(raw))}
    assert counts == {"unreadable value": 1, "null key": 1, "unknown region": 1}


def test_month_table_has_every_month(star):
    months = rows(star.months)
    assert sum(m["rows"] for m in months) == star.snap.count()
    assert max(m["last_day"] for m in months) == star.snap.agg(F.max("snapshot_date")).first()[0]


def test_loaded_star_can_be_reopened(spark, raw_of):
    path = new_path(spark, "reopen")
    star = P.load_star(spark, raw_of([{}, {"Product_ID": "P2"}]), path)
    again = P.read_star(spark, path)
    assert bag(again.snap) == bag(star.snap) and len(bag(again.prices)) == 2


def test_loaded_fact_equals_the_lazy_one(star):
    lazy = P.fact_snapshots(star.raw, star.dims)
    assert bag(star.snap.drop("snapshot_month")) == bag(lazy)
