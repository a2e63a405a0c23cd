"""Arithmetic shared by the reports: guarded division, tie-safe rounding, exact moments."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def quotient(top: Column, bottom: Column) -> Column:
    """``top / bottom`` in double, NULL where the divisor is 0 (ANSI mode would raise)."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def rnd(value: Column, places: int = 0) -> Column:
    """Round half away from zero on the decimal value, so a tie never depends on a binary digit."""
    wide = "decimal(28,10)" if places > 4 else "decimal(24,8)"
    return F.round(value.cast(wide), places).cast("double")


_HALF = 31  # squares are summed in two halves of this many bits, so that the sums stay in BIGINT


def moments(value: Column) -> list[Column]:
    """Count, sum and sum of squares of an integer column as exact, mergeable aggregates.

    Integers add up the same in any order, so averages and deviations built on them do not change
    with the partitioning. A square may have 62 bits; summing it in halves leaves room for billions
    of rows without decimal arithmetic per row.
    """
    wide = value.cast("bigint")
    square = wide * wide
    low = square.bitwiseAND(F.lit(2**_HALF - 1).cast("bigint"))
    return [F.count(value), F.sum(wide), F.sum(F.shiftright(square, _HALF)), F.sum(low)]


def moment_sums(value: Column, name: str) -> list[Column]:
    """``moments`` of a column under the names that ``mean_of`` and ``pop_sd`` know."""
    return [m.alias(n) for m, n in zip(moments(value), moment_names(name))]


def moment_names(name: str) -> list[str]:
    """Columns made by ``moment_sums(…, name)``; adding them up merges groups."""
    return [f"{name}_{part}" for part in ("n", "sum", "sq_high", "sq_low")]


def mean_of(name: str) -> Column:
    """Average from ``moment_sums(…, name)``."""
    return quotient(F.col(f"{name}_sum"), F.col(f"{name}_n"))


def pop_sd(name: str) -> Column:
    """Population standard deviation from ``moment_sums(…, name)``; 0 for a single value."""
    n, total, high, low = (F.col(c).cast("decimal(20,0)") for c in moment_names(name))
    spread = n * (high * F.lit(Decimal(2**_HALF)) + low) - total * total
    return quotient(F.sqrt(spread.cast("double")), n)
