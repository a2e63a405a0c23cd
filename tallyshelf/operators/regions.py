"""Attach regions: either the snapshot's own one or every region of its store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

VIA = ("store_regions", "snapshot")


def region_keys(via: str) -> list[str]:
    """Region columns to group the fact by before ``with_regions`` is called."""
    if via not in VIA:
        raise ValueError(f"region_via must be one of {VIA}, not {via!r}")
    return ["region_id"] if via == "snapshot" else []


def with_region_name(df: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    return df.join(dims["regions"], "region_id")


def with_regions(
    df: DataFrame, dims: Mapping[str, DataFrame], via: str = "store_regions",
) -> DataFrame:
    """Add ``region_name`` to rows that are already grouped.

    Going through the bridge repeats a row for each region of its store. Call it on aggregated
    rows: every region of a store sees the same totals, so nothing is lost by fanning out last.
    No hint is given; Spark broadcasts the bridge only while its size is below the limit.
    """
    if not region_keys(via):
        df = df.join(dims["store_regions"].select("store_id", "region_id"), "store_id")
    return with_region_name(df, dims)


def with_products(
    df: DataFrame, dims: Mapping[str, DataFrame], columns: Sequence[str] = ("category",),
) -> DataFrame:
    return df.join(dims["products"].select("product_id", *columns), "product_id")
