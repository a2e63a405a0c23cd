"""Clustering around centroids with the dimensions dealt out to shards, in whole numbers.

Vectors are packed into batches, and each batch is cut into blocks of columns, one for each shard.
A round of Lloyd's algorithm: the tasks of a shard compute the exact partial distances of their blocks
to their slice of the centroids; the blocks of a batch are reduced by key (partial distances are added,
the smallest sum names the cluster); the clusters go back to the blocks of the batch, and each shard
adds up and divides its own columns. No task needs whole vectors or whole centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, intermediates, new_path, read_table, write_table

CLUSTERS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: Columns of a shard; vectors of a batch.
COLUMNS, BATCH = 16, 2048
#: Components are exact below this bound: the squared distance of two such vectors fits 63 bits.
BOUND = 1 << 27

PACKED = "slot bigint, place bigint, shard int, rows int, ids array<bigint>, cells binary"
FOUND = "vec_id bigint, cluster int, distance bigint"
LABELLED = "slot bigint, place bigint, clusters binary, distances binary"


def _usable(vector: str, width: int):
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.when(F.size(v) == width, finite), F.lit(False))


def _packs(rows: DataFrame, width: int, batch: int) -> DataFrame:
    """Blocks of up to ``batch`` vectors: a row for each shard, ids along with the first shard only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch)
                whole = part.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for shard in range(-(-width // COLUMNS)):
                    own = whole[:, shard * COLUMNS:(shard + 1) * COLUMNS]
                    if not (np.abs(own) < BOUND).all():
                        raise OverflowError(f"components must stay below {BOUND // SCALE} for exact distances")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.column("slot")[0].as_py()]), pa.array([place]), pa.array([shard], pa.int32()),
                            pa.array([len(whole)], pa.int32()),
                            pa.array([part.column("vec_id").to_pylist() if shard == 0 else None], pa.list_(pa.int64())),
                            pa.array([own.astype("<i4").tobytes()], pa.binary()),
                        ],
                        names=["slot", "place", "shard", "rows", "ids", "cells"],
                    )
                place += 1

    placed = rows.select(F.spark_partition_id().cast("bigint").alias("slot"), "vec_id", "cells")
    return placed.mapInArrow(run, PACKED)


def _cells(column, i: int, rows: int) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), "<i4").reshape(rows, -1).astype(np.int64)


def _labelled(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """The nearest centroid of every vector of every batch, and its squared distance."""
    shipped = blocks.sparkSession.sparkContext.broadcast(centres)  # clusters x dimensions

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for i in range(given.num_rows):
                shard, rows = given.column("shard")[i].as_py(), given.column("rows")[i].as_py()
                cells = _cells(given.column("cells"), i, rows)
                own = shipped.value[:, shard * COLUMNS:(shard + 1) * COLUMNS]
                sums = np.empty((rows, len(own)), np.int64)
                for c, centre in enumerate(own):
                    gap = cells - centre
                    sums[:, c] = np.einsum("ij,ij->i", gap, gap)
                yield pa.RecordBatch.from_arrays(
                    [given.column("slot").slice(i, 1), given.column("place").slice(i, 1), pa.array([sums.tobytes()], pa.binary())],
                    names=["slot", "place", "sums"],
                )

    clusters = len(centres)

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), np.int64) for s in table.column("sums")).reshape(-1, clusters)
        best = total.argmin(1)  # the first of equal ones
        return pa.table({
            "slot": table.column("slot").slice(0, 1), "place": table.column("place").slice(0, 1),
            "clusters": pa.array([best.astype("<i4").tobytes()], pa.binary()),
            "distances": pa.array([total.min(1).astype("<i8").tobytes()], pa.binary()),
        })

    parts = blocks.select("slot", "place", "shard", "rows", "cells").mapInArrow(partial, "slot bigint, place bigint, sums binary")
    return parts.groupBy("slot", "place").applyInArrow(added, LABELLED)


def _moved(blocks: DataFrame, labels: DataFrame, centres: np.ndarray) -> np.ndarray:
    """New centroids: each shard's floored means over its own columns; empty clusters stay."""
    clusters, width = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for given in batches:
            for i in range(given.num_rows):
                shard, rows = given.column("shard")[i].as_py(), given.column("rows")[i].as_py()
                cells = _cells(given.column("cells"), i, rows)
                own = np.frombuffer(given.column("clusters")[i].as_py(), "<i4")
                total = found.setdefault(shard, np.zeros((clusters, cells.shape[1] + 1), np.int64))
                np.add.at(total, own, np.column_stack([cells, np.ones(rows, np.int64)]))  # the last column counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([t.tobytes() for t in found.values()], pa.binary())],
            names=["shard", "sums"],
        )

    shipped = blocks.sparkSession.sparkContext.broadcast(centres)

    def means(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        own = shipped.value[:, shard * COLUMNS:(shard + 1) * COLUMNS].copy()
        total = sum(np.frombuffer(s.as_py(), np.int64) for s in table.column("sums")).reshape(clusters, -1)
        full = total[:, -1] > 0
        own[full] = total[full, :-1] // total[full, -1:]
        return pa.table({
            "shard": pa.array([shard], pa.int32()), "centres": pa.array([own.astype(np.int64).tobytes()], pa.binary()),
        })

    joined = blocks.select("slot", "place", "shard", "rows", "cells").join(labels.select("slot", "place", "clusters"), ["slot", "place"])
    slices = (
        joined.mapInArrow(sums, "shard int, sums binary")  # a row a task and shard
        .groupBy("shard").applyInArrow(means, "shard int, centres binary")
    )
    moved = centres.copy()
    for row in slices.collect():  # clusters x dimensions in all
        at = row.shard * COLUMNS
        moved[:, at:at + COLUMNS] = np.frombuffer(row.centres, np.int64).reshape(clusters, -1)
    return moved


def _seeds(rows: DataFrame, clusters: int, width: int) -> np.ndarray:
    """The first centroids; rows without an id come last, equal ids in the order of their cells."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(key.alias("key"), "cells").orderBy(F.col("key").asc_nulls_last(), "cells").limit(clusters)
    return np.array([r.cells for r in first.collect()], np.int64).reshape(-1, width)


def clustered(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
    rounds: int = ROUNDS, width: int = WIDTH, batch: int = BATCH,
) -> DataFrame:
    """Every vector's cluster: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components count as floor(256 x). Vectors that are null, have another number of components than
    ``width``, or hold null or non-finite ones are left out. Equal vectors and repeated ids are rows of
    their own; a null id stays null and becomes a first centroid only where other ids run out. Ties go
    to the smaller cluster. With fewer vectors than ``clusters`` there are as many clusters as vectors;
    an empty table gives no rows. Only the two named columns are read. Components of 524,288 or more
    raise OverflowError, as their distances would not fit.
    """
    rows = embeddings.filter(_usable(vector_col, width)).select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * SCALE).cast("bigint")).alias("cells"),
    )
    with intermediates(embeddings.sparkSession):
        blocks = cut_lineage(_packs(rows, width, batch), "blocks")
        centres = _seeds(rows, clusters, width)
        if len(centres):
            for _ in range(rounds):
                labels = cut_lineage(_labelled(blocks, centres), "labels")
                centres = _moved(blocks, labels, centres)
            labels = _labelled(blocks, centres)
        else:
            labels = embeddings.sparkSession.createDataFrame([], LABELLED)
        named = blocks.filter("shard = 0").join(labels, ["slot", "place"])
        path = new_path(embeddings.sparkSession, "clusters")  # outlives the tables of the rounds
        write_table(named.select("ids", "clusters", "distances").mapInArrow(_rows, FOUND), path)
    found = read_table(embeddings.sparkSession, path, FOUND)
    hashed = [F.sha2(F.lit(",".join(map(str, c))), 256) for c in centres.tolist()]
    sizes = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    told = sizes.select(  # a row a cluster
        "*", sizes.agg(F.sum("cluster_inertia")).scalar().alias("inertia"),
        (F.element_at(F.array(*hashed), F.col("cluster") + 1) if hashed else F.lit(None).cast("string")).alias("centroid_sha256"),
    )
    return found.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for given in batches:
        for i in range(given.num_rows):
            yield pa.RecordBatch.from_arrays(
                [
                    given.column("ids")[i].values,
                    pa.array(np.frombuffer(given.column("clusters")[i].as_py(), "<i4")),
                    pa.array(np.frombuffer(given.column("distances")[i].as_py(), "<i8")),
                ],
                names=["vec_id", "cluster", "distance"],
            )


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """DuckDB SQL for ``op11_centroids``."""
    parts = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
            FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
        c0 AS MATERIALIZED (
            SELECT c, v FROM (
                SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1 AS c, v FROM kept) WHERE c < {clusters})"""]

    def assign(r: int) -> str:
        return f"""
        a{r} AS MATERIALIZED (
            SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
                SELECT rid, c.c AS c,
                       CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
                FROM kept k CROSS JOIN c{r} c) GROUP BY rid)"""

    for r in range(rounds):
        parts.append(assign(r))
        parts.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT c{r}.c AS c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
                SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                    SELECT c, i, sum(v[i]) AS s, count(*) AS n
                    FROM kept JOIN a{r} USING (rid) CROSS JOIN range(1, {width + 1}) t(i) GROUP BY c, i) GROUP BY c) m
            ON m.c = c{r}.c)""")
    parts.append(assign(rounds))
    return f"""
    WITH {",".join(parts)}
    SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance,
           CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM kept JOIN a{rounds} a USING (rid) JOIN c{rounds} c ON c.c = a.c"""


SQL = _sql()
