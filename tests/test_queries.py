"""Every registered query against DuckDB, and the shape of its plan."""

import re

import duckdb
import pytest
from conftest import SF, bag

import __spark_entry__ as entry_points
from tallyshelf import plans as P
from tallyshelf import registry
from tallyshelf.checks import oracle

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
QUERIES = registry.queries()
ORACLE = oracle.oracle_sql()
SPARK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, star, duck, name):
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert {c: SPARK_TYPES.get(t, t.upper()) for c, t in df.dtypes} == types
    assert bag(df) == expected
    assert expected


REPORTS = sorted(set(QUERIES) - {"raw_import", "raw_csv_round_trip"})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REPORTS)
def test_plan_has_no_pair_products_and_no_python(spark, star, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas|MapInArrow", plan)


#: Texts and maps as results, and numbering, which draws at most 1,024 names as borders.
NO_HASH = {"dim_products", "dim_regions", "dim_seasons", "dim_weather", "dims_incremental", "issue_map", "product_store_map"}


@pytest.mark.parametrize("name", sorted(set(REPORTS) - NO_HASH))
def test_aggregates_hash(spark, star, name):
    assert not re.search(r"\bSortAggregate|ObjectHashAggregate", plan_of(QUERIES[name](spark, SF)))


def test_reorder_points_reads_the_fact_once_and_shuffles_it_once(star):
    plan = plan_of(P.reorder_points(star.snap, star.dims))
    assert plan.count("snapshot_date#") and plan.count("hashpartitioning") == 1
    scans = [line for line in plan.splitlines() if "FileScan" in line and "inventory_level" in line]
    assert len(scans) == 1
    read = re.search(r"ReadSchema: struct<([^>]*)", scans[0]).group(1)
    assert "units_ordered" not in read and "demand_forecast" not in read


def files_read(df):
    """Files opened by the scans of an executed frame, subqueries included, by the first column they read."""
    found = {}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            name = node.output().head().name()
            found[name] = found.get(name, 0) + node.metrics().apply("numFiles").value()
        for below in (node.children(), node.subqueries()):
            nodes = below.iterator()
            while nodes.hasNext():
                walk(nodes.next())
        if kind == "SubqueryExec":
            walk(node.child())

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("report", [
    lambda s: P.supplier_inconsistency(s.snap, s.dims, month_table=s.months),
    lambda s: P.status_counts(s.snap, s.dims, month_table=s.months),
    lambda s: P.monthly_kpis(P.last_months(s.snap, 3, s.months)),
])
def test_recent_reports_open_recent_months_only(star, report):
    df = report(star)
    df.collect()
    months = star.snap.select("snapshot_month").distinct().count()
    assert files_read(df)["snapshot_date"] < months / 4


@pytest.mark.parametrize("name", ["reorder_points", "stockout_risk", "inventory_age", "stock_adjustment", "monthly_trend"])
def test_partitioning_does_not_change_results(spark, star, name):
    builds = {
        "reorder_points": lambda s: P.reorder_points(s, star.dims),
        "stockout_risk": lambda s: P.stockout_risk(s, star.dims),
        "inventory_age": lambda s: P.inventory_age(s),
        "stock_adjustment": lambda s: P.stock_adjustment(s, star.dims),
        "monthly_trend": lambda s: P.monthly_trend(s),
    }
    build = builds[name]
    expected = bag(build(star.snap))
    assert bag(build(star.snap.repartition(17))) == expected
    assert bag(build(star.snap.repartition(3, "product_id").sortWithinPartitions("units_sold"))) == expected


def test_seasonal_reorder_points_read_the_fact_once(star):
    plan = plan_of(P.seasonal_reorder_points(star.snap, star.dims))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "inventory_level" in line]
    assert len(scans) == 1 and plan.count("units_sold") and plan.count("hashpartitioning") <= 3


def test_entry_points_hold_every_report():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "stock_status" in df.columns
