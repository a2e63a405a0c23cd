"""Consecutive ids in name order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names drawn as borders of the slots, at most.
BORDERS = 1024


def numbered(
    names: DataFrame, by: str, id_name: str, after: DataFrame | None = None, within: str | None = None,
) -> DataFrame:
    """Distinct ``names`` with ids 1, 2, … in ``by`` order, anew for each value of ``within``.

    Ids start past ``after``: a one-value frame, or with ``within`` a frame of its values and the
    number to start past. Borders are drawn from the names by their hash, one of each of ``BORDERS``
    groups, so they are the same in every evaluation and whatever the partitions. A name's slot is the
    number of borders up to it, and its id is its place in the slot plus the size of the slots before.
    Nothing is written and no job runs until the ids are read.
    """
    group = [within] if within else []
    key = F.struct(*group, by)
    drawn = names.groupBy(F.pmod(F.xxhash64(*group, by), F.lit(BORDERS)).alias("_draw")).agg(
        F.min_by(key, F.xxhash64(*group, by)).alias("_border")
    )
    borders = drawn.agg(F.sort_array(F.collect_list("_border"))).scalar()
    up_to = F.size(F.filter("_borders", lambda border: border <= key))
    placed = names.withColumn("_borders", borders).withColumn("_slot", up_to).drop("_borders")
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_size"))  # a row a slot
        .select(*group, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    ident: Column = F.col("_offset") + F.row_number().over(Window.partitionBy(*group, "_slot").orderBy(by))
    rows = placed.join(offsets, [*group, "_slot"])
    if after is not None and within:
        last = next(c for c in after.columns if c != within)
        rows = rows.join(after.withColumnRenamed(last, "_last"), within, "left")
        ident = ident + F.coalesce("_last", F.lit(0))
    elif after is not None:
        ident = ident + F.coalesce(after.scalar(), F.lit(0))
    rest = [c for c in names.columns if c != id_name]
    return rows.select(ident.cast("int").alias(id_name), *rest)
