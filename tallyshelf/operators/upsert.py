"""Insert rows whose key is not there yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def insert_if_absent(
    target: DataFrame, new: DataFrame, keys: Sequence[str], id_name: str | None = None,
) -> DataFrame:
    """``target`` plus one row of ``new`` for each key it lacks; existing rows stay as they are.

    Among several new rows of one key the smallest by the remaining columns wins. With ``id_name``
    the added rows get ids after the largest existing one, in key order.
    """
    rest = [c for c in target.columns if c not in keys and c != id_name]
    fresh = new.join(target.select(*keys), list(keys), "left_anti")
    if rest:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
        fresh = fresh.select(*keys, "_row.*")
    else:
        fresh = fresh.select(*keys).distinct()
    if id_name:
        fresh = numbered(fresh, keys[0], id_name, after=target.agg(F.max(id_name)))
    return target.unionByName(fresh.select(*target.columns))
