"""Find replenishments: rows whose level exceeds the level of the row before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_index


def _grew(level: Column, before: Column, growth: tuple[int, int]) -> Column:
    # integers only: 3 * 1.2 is not 3.6 in binary
    more, per = growth
    return level.cast("bigint") * per > before.cast("bigint") * more


def replenishments(
    snap: DataFrame, keys: Sequence[str], tie: str, growth: tuple[int, int],
) -> DataFrame:
    """Per key the last day, and the last day whose inventory grew past ``growth``.

    The row before is taken in (snapshot_date, ``tie``) order. A key may own a large share of the
    table, so its rows are never put in one window: each calendar month is compared on its own,
    and what crosses a month boundary is settled on the reduced rows, one per key and month.
    """
    bucket = [*keys, "_month"]
    order = Window.partitionBy(*bucket).orderBy("snapshot_date", tie)
    level, day = F.col("inventory_level"), F.col("snapshot_date")
    rows = snap.select(
        *keys, tie, level, day, month_index(day).alias("_month"),
    ).select(
        *bucket, level, day,
        F.lag(level).over(order).alias("_before"),
        (F.row_number().over(order) == 1).alias("_first"),
        F.lead(F.lit(1)).over(order).isNull().alias("_last"),
    )
    months = rows.groupBy(*bucket).agg(
        F.max("snapshot_date").alias("_latest"),
        F.max(F.when(_grew(level, F.col("_before"), growth), day)).alias("_grown"),
        F.max(F.when(F.col("_first"), day)).alias("_opened"),
        F.max(F.when(F.col("_first"), level)).alias("_opening"),
        F.max(F.when(F.col("_last"), level)).alias("_closing"),
    )
    previous = F.lag("_closing").over(Window.partitionBy(*keys).orderBy("_month"))
    return (
        months.withColumn("_before", previous)
        .groupBy(*keys)
        .agg(
            F.max(
                F.greatest(
                    F.col("_grown"),
                    F.when(_grew(F.col("_opening"), F.col("_before"), growth), F.col("_opened")),
                )
            ).alias("last_replenishment"),
            F.max("_latest").alias("latest_date"),
        )
    )
