"""The stored star: loads, appends, compaction, and the markers that say what can be read.

Under one root, snapshots, prices, rejects and staged rows have one folder each, partitioned by
``part``: a part is what one load or append wrote. A reader makes one scan of the parts that the newest
marker names. Dimensions are small and written anew by every load or append.

    inventory_snapshots/part=…/snapshot_month=…     versions/…/stores, regions, …, snapshot_months
    price_history/part=…/price_month=…              markers/00000000, 00000001, …
    series_months/part=…, rejects/part=…, raw/part=…

``series_months`` holds the measures of a part's snapshots by month and series. A load or append makes
it of its own snapshots alone, so it costs what the new rows cost; readers merge the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assert_integrity, not_null_rule, unique_rule
from ..schema import DIMENSIONS, NOT_NULL, RAW, SNAPSHOT_KEY, STAR
from ..sources.clean import normalize_keys
from ..sources.raw_csv import BLOCK, CORRUPT, FILE
from ..sources.tables import (
    cut_lineage, drop_path, has_path, intermediates, names_in, new_path, read_table, rename_path, write_table,
)
from .load import (
    MONTH, PRICE_MONTH, UNREADABLE, build_dimensions, fact_snapshots, grow_dimensions, price_history, reject_reason,
    rejects,
)
from .rollup import ROLLUP, ROLLUP_SCHEMA, month_table, series_months

PART = "part"
SNAPSHOTS, PRICES = "inventory_snapshots", "price_history"
#: Tables with a folder for each part.
IN_PARTS = (SNAPSHOTS, PRICES, ROLLUP, "rejects", "raw")
KEY_COLUMNS = ("Store_ID", "Product_ID", "Category", "Region", "Weather_Condition", "Seasonality")


class UnreadableError(ValueError):
    """Raw rows hold values that do not fit their column."""


class ConflictError(RuntimeError):
    """Another load or append was published while this one ran."""


@dataclass(frozen=True)
class Star:
    """Loaded tables: the staged raw rows unless dropped, the fact with its month column, and the rest."""

    raw: DataFrame | None
    snap: DataFrame
    dims: dict[str, DataFrame]
    prices: DataFrame
    months: DataFrame
    rollup: DataFrame
    rejects: DataFrame
    path: str
    number: int
    version: str
    parts: tuple[str, ...]

    def tables(self) -> dict[str, DataFrame]:
        return {**self.dims, SNAPSHOTS: self.snap, PRICES: self.prices}

    def drop_stage(self) -> None:
        """Delete the staged raw rows; ``raw`` cannot be read afterwards, all else can."""
        for part in self.parts:
            drop_path(self.snap.sparkSession, _folder(self.path, "raw", part))


def load_star(
    spark: SparkSession, raw: DataFrame, path: str | None = None, *, unreadable: str = "refuse",
    keep_stage: bool = True, fold_keys: bool = False,
) -> Star:
    """Load all tables under ``path`` (default: the shared folder), check their rules, publish them.

    Rows that give no snapshot are written to a table ``rejects`` with the reason. Rows with a value
    that does not fit its column are among them with ``unreadable="set_aside"``; with ``"refuse"``
    they refuse the load. Nothing can be read before all rules hold and the marker that names the new
    part is in place; a refused load leaves no files and what was there before stays readable.
    ``keep_stage=False`` drops the staged raw rows; ``fold_keys`` takes keys that differ in case or
    outer blanks for one and the same.
    """
    path = path or new_path(spark, "star")
    return _load(spark, raw, path, None, unreadable, keep_stage, fold_keys)


def append_star(
    spark: SparkSession, path: str, raw: DataFrame, *, unreadable: str = "refuse", keep_stage: bool = True,
    fold_keys: bool = False,
) -> Star:
    """Load more days into the star published under ``path``.

    Known dimension rows keep their ids, new ones are added; new snapshots and prices are a part of
    their own, stored ones are not copied. Keys and prices are compared with the stored rows of those
    months only that the new rows fall in, however far apart. As with ``load_star``, nothing is
    published unless all rules hold.
    """
    return _load(spark, raw, path, read_star(spark, path), unreadable, keep_stage, fold_keys)


def read_star(spark: SparkSession, path: str) -> Star:
    """Open the tables that the newest marker under ``path`` names."""
    number, marker = _marker(spark, path)
    return _open(spark, path, number, marker.version, marker.parts)


def compact_star(spark: SparkSession, path: str, *, since: int = 0) -> Star:
    """Write the parts from position ``since`` on as one; every report stays the same.

    ``since=1`` leaves a first big load alone. Earlier markers keep naming the old parts, so readers
    are not disturbed; ``vacuum_star`` removes them.
    """
    newest, marker = _marker(spark, path)
    merged = marker.parts[since:]
    if len(merged) < 2:
        return read_star(spark, path)
    number, part = _next(spark, path, newest)
    try:
        rows = _read_parts(spark, path, SNAPSHOTS, merged)
        written = _write_snapshots(rows.drop(MONTH), _folder(path, SNAPSHOTS, part))
        _refuse({SNAPSHOTS: written}, {})
        _write_prices(_read_parts(spark, path, PRICES, merged), _folder(path, PRICES, part))
        write_table(series_months(_read_parts(spark, path, ROLLUP, merged)), _folder(path, ROLLUP, part))
        write_table(_read_parts(spark, path, "rejects", merged), _folder(path, "rejects", part))
        staged = [p for p in merged if has_path(spark, _folder(path, "raw", p))]
        if staged:
            write_table(_read_parts(spark, path, "raw", staged), _folder(path, "raw", part))
        _publish(spark, path, number, marker.version, [*marker.parts[:since], part])
    except Exception:
        _drop_part(spark, path, part)
        raise
    return read_star(spark, path)


def vacuum_star(spark: SparkSession, path: str, *, keep: int = 1) -> list[str]:
    """Delete what the newest ``keep`` markers do not name; gives back the folders that went.

    Frames opened by an older marker can no longer be read, and loads that are still being written
    would lose their files: run it when none is.
    """
    if keep < 1:
        raise ValueError("at least one marker must be kept")
    kept: dict[int, Row] = {}
    for number in _numbers(spark, path):
        if len(kept) < keep and (marker := _read_marker(spark, path, number)):
            kept[number] = marker
    if not kept:
        raise FileNotFoundError(f"no star was published under {path}")
    parts = {f"{PART}={p}" for m in kept.values() for p in m.parts}
    versions = {m.version for m in kept.values()}
    gone = [f"markers/{_name(n)}" for n in _numbers(spark, path) if n not in kept]
    gone += [f"versions/{v}" for v in names_in(spark, f"{path}/versions") if v not in versions]
    for table in IN_PARTS:
        found = names_in(spark, f"{path}/{table}")
        gone += [f"{table}/{p}" for p in found if p.startswith(f"{PART}=") and p not in parts]
    for folder in gone:
        drop_path(spark, f"{path}/{folder}")
    return gone


def _load(
    spark: SparkSession, raw: DataFrame, path: str, old: Star | None, unreadable: str, keep_stage: bool, fold_keys: bool,
) -> Star:
    if unreadable not in ("refuse", "set_aside"):
        raise ValueError(f"unreadable must be refuse or set_aside, not {unreadable}")
    number, part = _next(spark, path, old.number if old else None)
    try:
        stage = _stage(spark, normalize_keys(raw, KEY_COLUMNS) if fold_keys else raw, path, part, unreadable)
        with intermediates(spark):
            built = build_dimensions(stage, cut_lineage) if old is None else grow_dimensions(old.dims, stage, cut_lineage)
            dims = _write_dimensions(spark, built, _version(path, part))
        counted = _write_snapshots(fact_snapshots(stage, dims), _folder(path, SNAPSHOTS, part))
        new = _read_parts(spark, path, SNAPSHOTS, [part])
        prices = _with_price_month(price_history(stage, dims["regions"]))
        write_table(series_months(new), _folder(path, ROLLUP, part))
        rollups = [part]
        if old is not None:
            touched = _months_of(stage)
            rule = unique_rule(SNAPSHOT_KEY)
            checked, copies = counted[rule]
            counted[rule] = checked, copies + _stored_again(old.snap, new, touched)
            prices = _without_known(prices, old.prices.filter(F.col(PRICE_MONTH).isin(touched)))
            rollups += old.parts
        told = _write_prices(prices, _folder(path, PRICES, part))
        months = month_table(_read_parts(spark, path, ROLLUP, rollups))
        write_table(months.coalesce(1), f"{_version(path, part)}/snapshot_months")
        _refuse({SNAPSHOTS: counted, PRICES: told}, {
            **dims, SNAPSHOTS: new, PRICES: _read_parts(spark, path, PRICES, [part]),
        })
        if not keep_stage:
            drop_path(spark, _folder(path, "raw", part))
        parts = [*(old.parts if old else ()), part]
        _publish(spark, path, number, part, parts)
    except Exception:
        _drop_part(spark, path, part)
        raise
    return _open(spark, path, number, part, parts)


def _stage(spark: SparkSession, raw: DataFrame, path: str, part: str, unreadable: str) -> DataFrame:
    """Raw rows and their rejects, written; gives back the rows that can be read."""
    staged = raw.select(*RAW.names, *[c for c in (CORRUPT, FILE, BLOCK) if c in raw.columns])
    counts = Observation()
    bad = F.count_if(F.coalesce(reject_reason(staged) == UNREADABLE, F.lit(False))).alias("bad")
    write_table(staged.observe(counts, bad), _folder(path, "raw", part))
    if unreadable == "refuse" and counts.get.get("bad"):
        raise UnreadableError(f"{counts.get['bad']} raw rows hold unreadable values; unreadable='set_aside' loads the others")
    stage = spark.read.schema(staged.schema).parquet(_folder(path, "raw", part))
    write_table(rejects(stage), _folder(path, "rejects", part))
    if CORRUPT in stage.columns:
        stage = stage.filter(F.col(CORRUPT).isNull())
    return stage.select(*RAW.names)


def _write_dimensions(spark: SparkSession, dims: Mapping[str, DataFrame], version: str) -> dict[str, DataFrame]:
    for name, df in dims.items():
        write_table(df.select(*_columns(name)), f"{version}/{name}")
    return {name: _read(spark, version, name) for name in dims}


def _write_snapshots(fact: DataFrame, path: str) -> dict[str, tuple[int, int]]:
    """Write the fact in month folders, clustered by series; gives the rules counted on the way.

    The range shuffle runs on the month and the whole natural key, so a busy month, store or
    product is split over as many tasks as its size asks for. Rows of a series end up side by
    side, which lets the reports' map-side aggregation shrink them before any shuffle. Equal keys
    are neighbours in that order, so the same pass counts them and the empty mandatory columns.
    """
    order = [MONTH, "store_id", "product_id", "region_id", "snapshot_date"]
    rows = fact.withColumn(MONTH, F.trunc("snapshot_date", "MM"))
    clustered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    running = Window.partitionBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    second = F.count(F.lit(1)).over(running) == 2  # one row for each key that occurs again
    return _write_counted(
        clustered.withColumn("_again", second), path, MONTH, SNAPSHOTS, {unique_rule(SNAPSHOT_KEY): F.col("_again")}
    )


def _write_prices(prices: DataFrame, path: str) -> dict[str, tuple[int, int]]:
    # months by size: small ones share a task and a file, large ones are split
    return _write_counted(prices.hint("rebalance", PRICE_MONTH), path, PRICE_MONTH, PRICES, {})


def _write_counted(
    df: DataFrame, path: str, by: str, name: str, rules: Mapping[str, Column],
) -> dict[str, tuple[int, int]]:
    """Write a table in month folders and count, in the same pass, the rows that break each rule."""
    breaks = {**rules, **{not_null_rule(c): F.col(c).isNull() for c in NOT_NULL[name]}}
    counts = Observation()
    told = df.observe(
        counts, F.count(F.lit(1)).alias("rows"), *[F.count_if(b).alias(rule) for rule, b in breaks.items()]
    )
    write_table(told.select(*_columns(name), by), path, partition_by=[by])
    found = counts.get
    return {rule: (found.get("rows") or 0, found.get(rule) or 0) for rule in breaks}


def _refuse(counted: Mapping[str, Mapping[str, tuple[int, int]]], tables: Mapping[str, DataFrame]) -> None:
    if tables:
        return assert_integrity(tables, counted)
    broken = [f"{t}: {rule}" for t, rules in counted.items() for rule, (_, bad) in rules.items() if bad]
    if broken:
        raise RuntimeError(f"rewritten parts break rules they held before: {'; '.join(broken)}")


def _with_price_month(prices: DataFrame) -> DataFrame:
    return prices.withColumn(PRICE_MONTH, F.trunc("effective_date", "MM"))


def _months_of(stage: DataFrame) -> list:
    """Calendar months of the staged rows: a value for each month, however many rows."""
    months = stage.select(F.trunc("Date", "MM").alias("month")).filter("month IS NOT NULL").distinct()
    return [r.month for r in months.collect()]


def _stored_again(stored: DataFrame, new: DataFrame, months: list) -> int:
    """How many of the new keys are stored already; opens the stored files of ``months`` only."""
    keys = [MONTH, *SNAPSHOT_KEY]
    return new.select(*keys).join(stored.filter(F.col(MONTH).isin(months)).select(*keys), keys, "left_semi").count()


def _without_known(prices: DataFrame, known: DataFrame) -> DataFrame:
    known = known.select([F.col(c).alias(f"_{c}") for c in prices.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in prices.columns]
    return prices.join(known, same, "left_anti")


def _name(number: int) -> str:
    return f"{number:08d}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the markers, newest first."""
    return sorted((int(n) for n in names_in(spark, f"{path}/markers") if n.isdigit()), reverse=True)


def _next(spark: SparkSession, path: str, after: int | None = None) -> tuple[int, str]:
    """Number of the next marker, and a new part named after it.

    What builds on a marker goes ``after`` it: if another writer did the same, the number is taken when
    it is to be published, and nothing that the other one added can get lost.
    """
    number = (max(_numbers(spark, path), default=-1) if after is None else after) + 1
    return number, f"{_name(number)}-{uuid.uuid4().hex[:12]}"


MARKER = "version string, parts array<string>"


def _read_marker(spark: SparkSession, path: str, number: int) -> Row | None:
    return read_table(spark, f"{path}/markers/{_name(number)}", MARKER).first()


def _marker(spark: SparkSession, path: str) -> tuple[int, Row]:
    """The newest marker that was written to its end, and its number."""
    for number in _numbers(spark, path):
        if marker := _read_marker(spark, path, number):
            return number, marker
    raise FileNotFoundError(f"no star was published under {path}")


def _publish(spark: SparkSession, path: str, number: int, version: str, parts: Sequence[str]) -> None:
    """Write the marker under a hidden name, then rename it: it is there as a whole or not at all."""
    marker = spark.range(1).select(F.lit(version).alias("version"), F.array(*map(F.lit, parts)).alias("parts"))
    hidden = f"{path}/markers/.{uuid.uuid4().hex}"
    write_table(marker.coalesce(1), hidden)
    if not rename_path(spark, hidden, f"{path}/markers/{_name(number)}"):
        drop_path(spark, hidden)
        raise ConflictError(f"marker {number} under {path} was published by another load meanwhile")


def _folder(path: str, table: str, part: str) -> str:
    return f"{path}/{table}/{PART}={part}"


def _version(path: str, version: str) -> str:
    return f"{path}/versions/{version}"


def _drop_part(spark: SparkSession, path: str, part: str) -> None:
    for folder in [*(_folder(path, table, part) for table in IN_PARTS), _version(path, part)]:
        drop_path(spark, folder)


def _read_parts(spark: SparkSession, path: str, table: str, parts: Sequence[str]) -> DataFrame:
    """One scan over the named parts of a table; folders of other parts are not even listed."""
    schema = _schema(table)
    names = [column.split()[0] for column in schema.split(", ")]
    reader = spark.read.schema(f"{schema}, {PART} string").option("basePath", f"{path}/{table}")
    return reader.parquet(*[_folder(path, table, p) for p in parts]).select(*names)


def _open(spark: SparkSession, path: str, number: int, version: str, parts: Sequence[str]) -> Star:
    """Dimensions of ``version`` with the snapshots, prices, rejects and staged rows of all ``parts``."""
    own = _version(path, version)
    found = set(names_in(spark, f"{path}/raw"))
    staged = [p for p in parts if f"{PART}={p}" in found]
    return Star(
        raw=_read_parts(spark, path, "raw", staged) if staged else None,
        snap=_read_parts(spark, path, SNAPSHOTS, parts),
        dims={name: _read(spark, own, name) for name in DIMENSIONS},
        prices=_read_parts(spark, path, PRICES, parts),
        months=_read(spark, own, "snapshot_months"),
        rollup=_read_parts(spark, path, ROLLUP, parts),
        rejects=_read_parts(spark, path, "rejects", parts),
        path=path,
        number=number,
        version=version,
        parts=tuple(parts),
    )


OTHERS = {
    "raw": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW),
    "rejects": "line string, reason string, file string, block bigint",
    ROLLUP: ROLLUP_SCHEMA,
    "snapshot_months": f"{MONTH} date, first_day date, last_day date, rows bigint",
}
MONTHS_OF = {SNAPSHOTS: MONTH, PRICES: PRICE_MONTH}


def _schema(name: str) -> str:
    if name in OTHERS:
        return OTHERS[name]
    return STAR[name] + (f", {MONTHS_OF[name]} date" if name in MONTHS_OF else "")


def _columns(name: str) -> list[str]:
    return [column.split()[0] for column in STAR[name].split(", ")]


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_table(spark, f"{path}/{name}", _schema(name))
