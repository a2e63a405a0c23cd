"""The raw daily CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW

# The text that stands for NULL in the file, and the column flagging bad lines.
NULL_TOKEN = "\\N"
CORRUPT = "_corrupt_record"
#: Where a line was read: its file, and the first byte of the block a task read it from.
FILE, BLOCK = "_file", "_block"


def read_raw_csv(spark: SparkSession, path: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """Read raw rows by position, skipping the header line of each file.

    A value that does not fit its column becomes NULL and the line is kept in ``_corrupt_record``.
    ``_file`` and ``_block`` tell where it was read. An empty text stays an empty text. ``multi_line`` allows line breaks inside quotes at the price
    of one task per file.
    """
    texts = T.StructType(
        [T.StructField(f.name, T.StringType()) for f in RAW] + [T.StructField(CORRUPT, T.StringType())]
    )
    lines = (
        spark.read.schema(texts)
        .options(header=True, quote='"', escape='"', mode="PERMISSIVE", multiLine=multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    origin = F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK)
    return typed(lines.select("*", *origin))


def typed(lines: DataFrame) -> DataFrame:
    """Cast the text columns of raw lines."""
    values = [_typed(f) for f in RAW]
    misfit = F.lit(False)
    for field, value in zip(RAW, values):
        if not isinstance(field.dataType, T.StringType):
            given = F.col(field.name).isNotNull() & (F.trim(field.name) != NULL_TOKEN)
            misfit = misfit | (given & value.isNull())
    line = F.concat_ws(",", *[F.coalesce(f.name, F.lit("")) for f in RAW])
    return lines.select(
        *[v.alias(f.name) for f, v in zip(RAW, values)],
        F.coalesce(F.col(CORRUPT), F.when(misfit, line)).alias(CORRUPT),
        *[c for c in (FILE, BLOCK) if c in lines.columns],
    )


def _typed(field: T.StructField) -> Column:
    text = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r$", "")
        return F.when(text != NULL_TOKEN, text)
    return F.trim(F.regexp_replace(text, "\r$", "")).try_cast(field.dataType)
