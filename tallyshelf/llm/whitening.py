"""Whitening of embeddings by block matrices.

Rows get consecutive numbers, are centred in whole numbers and become a BlockMatrix. Its transpose times
itself is the scatter matrix; the middle dimension is split, so that no task meets more than ``SPLIT``
blocks of rows. The eigenvectors of that small matrix are found on the driver, and one more product
with the scaled eigenvectors projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Rows of a block; blocks that meet in one task of a product.
BLOCK, SPLIT = 1024, 32
#: Eigenvalues below this share of the trace count as zero: no component is drawn from them.
FLAT = 1e-12


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with consecutive numbers ``index`` from 0: the place in a partition after those before.

    The placement is a written table, so that every use of the numbers sees the same ones.
    """
    low = F.lit((1 << 33) - 1)
    placed = cut_lineage(rows.select(
        "*", F.spark_partition_id().alias("_slot"), F.monotonically_increasing_id().bitwiseAND(low).alias("_place")
    ), "rows")
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))  # a row a partition
    return placed.join(starts, "_slot").withColumn("index", F.col("_start") + F.col("_place")).drop("_slot", "_place", "_start")


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right`` with the middle dimension cut into ``splits`` groups of blocks."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def _gram(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose times the matrix, small enough for the driver."""
    return _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _kept(matrix: BlockMatrix) -> BlockMatrix:
    """Blocks that several products read: kept on the executors, rebuilt from the written rows if one is lost."""
    return matrix.persist(StorageLevel.MEMORY_AND_DISK)


def _free(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _block_matrix(rows: DataFrame, count: int, width: int) -> BlockMatrix:
    """Rows (index, vector) as blocks that hold every column."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, count, width).toBlockMatrix(BLOCK, width)


def _width(rows: DataFrame) -> int | None:
    """The most frequent length, the smaller of equally frequent ones."""
    sizes = rows.groupBy(F.size("y").alias("size")).count().filter("size > 0")  # a row a length
    found = sizes.orderBy(F.desc("count"), "size").first()
    return found.size if found else None


def whitened(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each entry c counts as floor(64 c) + 1,000,000. Vectors that are null or empty or hold null or
    non-finite entries are left out, and so are those whose length is not the table's most frequent one
    (the smaller of equally frequent ones). Equal vectors and repeated or null ids are rows of their own
    and all count in the fit. Components are numbered by falling eigenvalue; where eigenvalues are equal
    any basis of their space may come out. Components without variance are left out, so that one vector
    alone, or equal vectors only, give no rows, as does an empty table. ``deviation`` is exact and NULL
    where it does not fit a long. Only the two named columns are read.
    """
    spark = embeddings.sparkSession
    v = F.col(f"`{vector_col}`")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.filter(F.coalesce(good, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        # the shift cancels in every deviation from the mean; small numbers keep their products in a long
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint")).alias("y"),
    )
    width = _width(rows)
    empty = spark.createDataFrame([], ROWS)
    if width is None:
        return empty
    rows = _numbered(rows.filter(F.size("y") == width))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("y")[i]) for i in range(width)]).alias("s")).first()
    n, total = sums.n, sums.s
    centred = rows.select(
        "index", F.zip_with("y", F.lit(total), lambda y, s: (y * n - s).cast("double") / n).alias("vector")
    )
    splits = max(1, -(-n // (BLOCK * SPLIT)))
    matrix = _kept(_block_matrix(centred, n, width))
    variance = _gram(matrix, splits) / n
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > FLAT * max(np.trace(variance), 0.0)][:components]
    if not order:
        _free(matrix)
        return empty
    scaled = vectors[:, order] / np.sqrt(values[order])
    small = Matrices.dense(width, len(order), scaled.T.ravel().tolist())
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), small)], 1), width, len(order))
    projected = _kept(_product(matrix, weights, 1))
    error = float(np.abs(_gram(projected, splits) / n - np.eye(len(order))).max())
    places = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    places = cut_lineage(places.select("index", vector_to_array("vector").alias("whitened")), "whitened")
    _free(projected)
    _free(matrix)
    shares = F.array(*[F.lit(float(values[i] / np.trace(variance))) for i in order])
    exact = F.lit(n * n).cast("decimal(38,0)")
    own, cross = (
        F.aggregate(F.zip_with("y", other, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
        for other in (F.col("y"), F.lit(total))
    )
    # the sum of (n y - s)^2 over the dimensions, multiplied out
    deviation = exact * own.cast("decimal(38,0)") - F.lit(2 * n).cast("decimal(38,0)") * cross.cast("decimal(38,0)")
    deviation = deviation + F.lit(sum(s * s for s in total)).cast("decimal(38,0)")
    told = rows.select("index", "vec_id", deviation.cast("decimal(38,0)").try_cast("bigint").alias("deviation"))
    return told.join(places, "index").select(
        "vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("place", "cell")
    ).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.col("cell.whitened").alias("whitened"), F.col("cell.explained").alias("explained"), F.lit(error).alias("identity_error"),
    )


ROWS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
