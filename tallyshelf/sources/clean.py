"""Text clean-up of imported or reported columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space as it is stripped from both ends, and the accepted month format.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_MONTH = "yyyy-M"


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove NUL characters, then white space at both ends."""
    return df.withColumns({
        c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "\\x00", ""), _EDGES, "")
        for c in columns
    })


def parse_month(df: DataFrame, column: str) -> DataFrame:
    """Turn ``yyyy-MM`` text into the first day of the month and drop rows that do not parse."""
    day = F.try_to_timestamp(F.col(column), F.lit(_MONTH)).cast("date")
    return df.withColumn(column, day).dropna(subset=[column])


def normalize_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Opt-in: fold case and outer blanks, for inputs that spell one key in several ways."""
    return df.withColumns({c: F.lower(F.trim(c)) for c in columns})
