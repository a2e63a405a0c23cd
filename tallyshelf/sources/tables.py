"""Tables kept in the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``, else the checkpoint folder set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/tallyshelf/{application}/{name}-{uuid.uuid4().hex}"


_watched: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``cut_lineage`` writes inside, when what was made of them is written."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield
    finally:
        _watched.remove(paths)
        for path in paths:
            drop_path(spark, path)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives executors, has a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _watched:
        _watched[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(
    df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "error",
) -> None:
    """Parquet sink for tables and report frames."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table's files; nothing happens if there are none."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def has_path(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders and files in a folder; none if it is not there."""
    files, place = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder its final name in one step; False if that name is taken."""
    files, place = _file_system(spark, old)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    return not files.exists(target) and files.rename(place, target)


def stamp(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Size and time of each table, through the file system that Spark reads it by."""
    found = []
    for path in paths:
        files, place = _file_system(spark, path)
        status = files.getFileStatus(place)
        found.append((files.getContentSummary(place).getLength(), status.getModificationTime()))
    return tuple(found)
