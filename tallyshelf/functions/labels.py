"""CASE ladders."""

from __future__ import annotations

import operator
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq,
}


def label_ladder(
    value: Column, rungs: Sequence[tuple[str, Column | float, object]], default: object,
) -> Column:
    """First rung ``(comparison, bound, label)`` that holds wins; NULL compares false on each."""
    ladder = F
    for compare, bound, label in rungs:
        ladder = ladder.when(_COMPARE[compare](value, bound), F.lit(label))
    return ladder.otherwise(F.lit(default))
