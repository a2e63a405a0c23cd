"""Month and week arithmetic on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    """Months since year 0 as an int: cheap to group by, and consecutive across years."""
    return F.year(day) * 12 + F.month(day) - 1


def month_label(index: Column) -> Column:
    """``yyyy-MM`` text of a month index."""
    first = F.make_date((index / 12).cast("int"), index % 12 + 1, F.lit(1))
    return F.date_format(first, "yyyy-MM")


def week_of_year(day: Column) -> Column:
    """Week 0-53, Monday first, week 1 being the first with at least four days.

    Unlike ISO weeks it never moves a day to the neighbouring year: days before week 1 are in
    week 0, and the last days of December may be in week 53.
    """
    nth = F.dayofyear(day) - 1
    new_year = F.pmod(F.weekday(day) - nth, F.lit(7))  # weekday of 1 January, Monday = 0
    week = F.floor((nth + new_year) / 7).cast("int")
    return week + F.when(new_year <= 3, 1).otherwise(0)
