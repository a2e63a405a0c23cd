"""The stored star: parts, markers, compaction, rules counted while writing, and the rollup."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

import pytest
from conftest import bag, day, rows
from pyspark.sql import functions as F

from tallyshelf import plans as P
from tallyshelf.operators import IntegrityError, integrity_report
from tallyshelf.plans import star as stored
from tallyshelf.schema import SERIES
from tallyshelf.sources import read_raw_csv
from tallyshelf.sources.raw_csv import NULL_TOKEN
from tallyshelf.sources.tables import new_path
from test_queries import files_read


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(path):
    return pathlib.Path(path.removeprefix("file:").removeprefix("//"))


def batch(month, count=6, **more):
    return [{"Date": day(f"2000-{month:02d}-{d:02d}"), "Inventory_Level": 7 * d * month % 23, "Units_Sold": d * month % 5,
             "Region": ("North", "South")[d % 2], **more} for d in range(1, count + 1)]


@pytest.fixture(scope="module")
def grown(spark, raw_of):
    """A load and three appends, the last of them with days of two earlier months."""
    path = new_path(spark, "parts")
    P.load_star(spark, raw_of(batch(1) + batch(2)), path)
    P.append_star(spark, path, raw_of(batch(3)), keep_stage=False)
    P.append_star(spark, path, raw_of(batch(4, Product_ID="P2")))
    late = [{"Date": day("2000-01-20"), "Region": "East"}, {"Date": day("2000-04-20"), "Inventory_Level": 0}]
    P.append_star(spark, path, raw_of(late))
    return path


def copy_of(spark, path):
    new = new_path(spark, "copy")
    shutil.copytree(folder(path), folder(new))
    return new


REPORTS = {
    "current_stock": lambda f, s: P.current_stock(f, s.dims),
    "reorder_points": lambda f, s: P.reorder_points(f, s.dims, min_obs=2),
    "monthly_turnover": lambda f, s: P.monthly_turnover(f, s.dims),
    "stockout_rate": lambda f, s: P.stockout_rate(f, s.dims),
    "stockout_rate_own_region": lambda f, s: P.stockout_rate(f, s.dims, region_via="snapshot"),
    "sell_through_store_month": lambda f, s: P.sell_through_store_month(f, s.dims),
    "average_stock_level": lambda f, s: P.average_stock_level(f, s.dims),
    "dead_stock": lambda f, s: P.dead_stock(f),
    "monthly_kpis": lambda f, s: P.monthly_kpis(f),
    "monthly_trend": lambda f, s: P.monthly_trend(f),
    "demand_trend": lambda f, s: P.demand_trend(f),
}


def test_all_parts_are_one_scan(spark, grown):
    star = P.read_star(spark, grown)
    assert len(star.parts) == 4
    assert plan_of(star.snap).count("FileScan") == plan_of(star.prices).count("FileScan") == 1
    assert star.snap.count() == 26 and {f.split("part=")[1].split("/")[0] for f in star.snap.inputFiles()} == set(star.parts)


def test_fifty_parts_are_one_scan(spark, grown):
    path = copy_of(spark, grown)
    star = P.read_star(spark, path)
    for table in stored.IN_PARTS:
        for i in range(46):
            source = folder(path) / table / f"part={star.parts[1 if table != 'raw' else 0]}"
            if source.exists():
                shutil.copytree(source, folder(path) / table / f"part=more{i}")
    stored._publish(spark, path, 77, star.version, [*star.parts, *(f"more{i}" for i in range(46))])
    many = P.read_star(spark, path)
    assert len(many.parts) == 50 and many.snap.count() == 26 + 46 * 6
    assert all(plan_of(df).count("FileScan") == 1 for df in (many.snap, many.prices, many.rollup, many.rejects, many.raw))


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_rollup_gives_the_same_report_without_the_fact(spark, grown, name):
    star = P.read_star(spark, grown)
    from_rollup = REPORTS[name](star.rollup, star)
    assert bag(from_rollup) == bag(REPORTS[name](star.snap, star))
    assert "inventory_snapshots" not in plan_of(from_rollup)


def test_rollup_of_the_given_tables(star):
    for name in ("reorder_points", "monthly_turnover", "monthly_kpis"):
        assert bag(REPORTS[name](star.rollup, star)) == bag(REPORTS[name](star.snap, star))


@pytest.mark.parametrize("since", [0, 1])
def test_compaction_changes_no_report(spark, grown, since):
    path = copy_of(spark, grown)
    before = P.read_star(spark, path)
    tables = {n: bag(t) for n, t in before.tables().items()}
    reports = {n: bag(r(before.rollup, before)) for n, r in REPORTS.items()}
    left = bag(before.rejects), bag(before.months), bag(before.raw)
    star = P.compact_star(spark, path, since=since)
    assert len(star.parts) == since + 1 and star.parts[:since] == before.parts[:since]
    assert bag(before.snap) == tables["inventory_snapshots"]  # open readers are not disturbed
    P.vacuum_star(spark, path)
    star = P.read_star(spark, path)
    assert {n: bag(t) for n, t in star.tables().items()} == tables
    assert {n: bag(r(star.rollup, star)) for n, r in REPORTS.items()} == reports
    assert (bag(star.rejects), bag(star.months), bag(star.raw)) == left
    assert {p.name for p in (folder(path) / "inventory_snapshots").iterdir() if p.is_dir()} == {f"part={p}" for p in star.parts}
    again = P.append_star(spark, path, spark.createDataFrame([], P.read_star(spark, grown).raw.schema))
    assert again.snap.count() == 26 and P.compact_star(spark, path).snap.count() == 26


def test_vacuum_keeps_what_the_newest_markers_name(spark, raw_of):
    path = new_path(spark, "vacuum")
    for month in (1, 2, 3):
        P.load_star(spark, raw_of(batch(month)), path)
    gone = P.vacuum_star(spark, path, keep=2)
    assert len(gone) == 2 + len(stored.IN_PARTS)  # one marker, one version, one part of each table
    assert len(list((folder(path) / "versions").iterdir())) == 2
    assert P.vacuum_star(spark, path, keep=2) == []
    with pytest.raises(ValueError):
        P.vacuum_star(spark, path, keep=0)
    assert P.read_star(spark, path).snap.count() == 6


def test_a_crash_before_the_marker_leaves_the_old_star(spark, raw_of, grown, monkeypatch):
    path = copy_of(spark, grown)

    def crash(*args):
        raise OSError("no more")

    monkeypatch.setattr(stored, "rename_path", crash)
    with pytest.raises(OSError):
        P.append_star(spark, path, raw_of(batch(7)))
    monkeypatch.undo()
    assert P.read_star(spark, path).snap.count() == 26
    assert len([p for p in (folder(path) / "inventory_snapshots").iterdir() if p.is_dir()]) == 4
    (folder(path) / "markers" / "00000099").mkdir()  # a marker that was never filled
    (folder(path) / "markers" / "00000099" / "_SUCCESS").touch()
    assert P.read_star(spark, path).snap.count() == 26
    P.vacuum_star(spark, path)  # keeps the newest marker that can be read
    assert P.read_star(spark, path).snap.count() == 26 and not (folder(path) / "markers" / "00000099").exists()


def test_two_writers_cannot_publish_the_same_number(spark, raw_of, grown, monkeypatch):
    path = copy_of(spark, grown)
    before = P.read_star(spark, path)
    P.append_star(spark, path, raw_of(batch(8)))
    monkeypatch.setattr(stored, "read_star", lambda *_: before)  # the other writer started from the same marker
    with pytest.raises(P.ConflictError):
        P.append_star(spark, path, raw_of(batch(9)))
    monkeypatch.undo()
    assert P.read_star(spark, path).snap.count() == 32


def test_keys_of_other_parts_are_compared_in_touched_months_only(spark, raw_of, grown, monkeypatch):
    path, seen = copy_of(spark, grown), []
    again = stored._stored_again
    monkeypatch.setattr(stored, "_stored_again", lambda *a: seen.append(a) or again(*a))
    with pytest.raises(IntegrityError, match="unique.*broken by 1 of 2"):
        P.append_star(spark, path, raw_of([batch(2)[0], {"Date": day("2000-12-31")}]))
    old, new, months = seen[0]
    assert sorted(months) == [day("2000-02-01"), day("2000-12-01")]
    stored_rows = old.filter(F.col("snapshot_month").isin(months)).select("snapshot_date")
    assert stored_rows.count() == 6
    stored_rows.collect()
    assert files_read(stored_rows)["snapshot_date"] <= 2  # February has one file, December none
    assert P.read_star(spark, path).snap.count() == 26


def test_known_prices_are_not_stored_again(spark, raw_of):
    path = new_path(spark, "prices")
    P.load_star(spark, raw_of([{"Discount": None}, {"Product_ID": "P2"}]), path)
    star = P.append_star(spark, path, raw_of([
        {"Discount": None, "Store_ID": "S2"}, {"Product_ID": "P2", "Store_ID": "S2"}, {"Product_ID": "P3", "Store_ID": "S2"},
    ]))
    assert sorted(r["product_id"] for r in rows(star.prices)) == ["P1", "P2", "P3"]


def test_rules_are_counted_in_the_one_shuffle_of_the_write(spark, raw_of, monkeypatch):
    frames = {}
    write = stored._write_counted
    monkeypatch.setattr(stored, "_write_counted", lambda df, *a: frames.setdefault(a[2], df) and write(df, *a))
    star = P.load_star(spark, raw_of(batch(1) + batch(2)), new_path(spark, "counted"))
    # the frame is read from the stage, whose folder is still there
    plan = plan_of(frames["inventory_snapshots"])
    assert plan.count("rangepartitioning") == 1 and plan.count("Window ") == 1 and plan.count("+- Sort [") == 1
    assert not re.search(r"hashpartitioning\([^)]*product_id", plan)
    counted = {"inventory_snapshots": {"unique(x)": (12, 0)}, "price_history": {"not null(y)": (1, 0)}}
    report = plan_of(integrity_report(star.tables(), counted))
    assert not re.search(r"HashAggregate\(keys=\[[^]]*snapshot_date", report)


def test_double_keys_and_missing_values_refuse_a_load(spark, raw_of):
    twice = batch(1) + batch(1)[:2] + batch(1)[:1] + [{"Product_ID": "P9", "Units_Sold": None}]
    with pytest.raises(IntegrityError) as error:
        P.load_star(spark, raw_of(twice), new_path(spark, "twice"))
    assert "unique(snapshot_date, store_id, region_id, product_id) broken by 2 of 10" in str(error.value)
    assert "not null(units_sold) broken by 1 of 10" in str(error.value)


def test_loads_without_a_snapshot(spark, raw_of):
    for records in ([], [{"Region": ""}, {"Product_ID": None}]):
        frame = raw_of(records) if records else raw_of([{}]).limit(0)
        star = P.load_star(spark, frame, new_path(spark, "none"))
        assert star.snap.count() == 0 and star.prices.count() == 0 and star.rejects.count() == len(records)
        assert bag(P.append_star(spark, star.path, raw_of(batch(1))).months.select("rows")) == [(6,)]


def test_rejects_of_every_part_say_where_they_stood(spark, tmp_path, raw_of):
    path = new_path(spark, "rejected")
    for i, load in enumerate((P.load_star, P.append_star)):
        lines = raw_of(batch(i + 1) + [{"Region": "", "Date": day(f"200{i}-01-01")}])
        lines.coalesce(1).write.options(header=True, nullValue=NULL_TOKEN, emptyValue="").csv(f"{tmp_path}/in{i}")
        load(spark, path=path, raw=read_raw_csv(spark, f"{tmp_path}/in{i}"))
    found = rows(P.read_star(spark, path).rejects.orderBy("line"))
    assert [f["line"][:10] for f in found] == ["2000-01-01", "2001-01-01"]
    assert [re.search(r"/in(\d)/part-", f["file"]).group(1) for f in found] == ["0", "1"] and {f["block"] for f in found} == {0}
    assert rows(P.rejects(raw_of([{"Region": ""}])))[0]["file"] is None


def test_keys_that_differ_in_case_can_be_folded(spark, raw_of):
    records = [{"Region": "North"}, {"Region": " north", "Date": day("2000-01-02")}, {"Store_ID": "s1", "Date": day("2000-01-03")}]
    star = P.load_star(spark, raw_of(records), new_path(spark, "folded"), fold_keys=True)
    assert star.dims["regions"].count() == star.dims["stores"].count() == 1 and star.snap.count() == 3
    assert star.snap.select(*SERIES).distinct().count() == 1


@pytest.mark.parametrize("build", [
    lambda s: P.stockout_risk(s.snap, s.dims), lambda s: P.stock_adjustment(s.snap, s.dims), lambda s: P.inventory_age(s.snap, s.dims),
])
def test_reports_read_the_fact_once(star, build):
    plan = plan_of(build(star))
    assert len([line for line in plan.splitlines() if "FileScan" in line and "inventory_level" in line]) == 1


def test_rest_imports_without_the_corpus_folders(tmp_path):
    root = pathlib.Path(__file__).parent.parent
    kept = shutil.copytree(root / "tallyshelf", tmp_path / "tallyshelf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"

    def run():
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
        assert done.returncode == 0, done.stderr
        return done.stdout.split()

    alone = run()
    assert alone[1] == "True" and int(alone[0]) >= 45 and kept.exists()
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)  # left over on its own it has nothing to call
        assert run() == alone
