"""Pivots with a known column list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_fixed(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], cell: str,
    fill: int | None = None,
) -> DataFrame:
    """One row per ``rows``, one column per listed value holding the smallest ``cell``."""
    wide = df.groupBy(*rows).pivot(column, list(values)).agg(F.min(cell))
    return wide if fill is None else wide.fillna(fill, subset=list(values))


def pivot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values to use as pivot columns.

    Each becomes a column, so more than ``spark.sql.pivotMaxValues`` of them is an error.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    values = [row[0] for row in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values; a pivot would need as many columns")
    return values
