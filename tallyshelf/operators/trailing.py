"""Mean of the months before the current one, by calendar and not by row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def trailing_months(keys: Sequence[str], index: str, value: str, months: int) -> tuple[Column, Column]:
    """Sum and number of the rows of the ``months`` months before; NULL and 0 if there are none.

    The range frame on the month index skips gaps and crosses years. Rows must be monthly, so a
    window partition holds as many rows as the history has months.
    """
    frame = Window.partitionBy(*keys).orderBy(index).rangeBetween(-months, -1)
    return F.sum(value).over(frame), F.count(value).over(frame)
