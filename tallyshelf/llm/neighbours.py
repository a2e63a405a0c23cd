"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Each tree halves the vectors again and again at the median of their projection on a random direction,
one direction a level. Medians come from a bounded sample; every vector is then routed to its leaf in
every tree. A query walks all trees at once with one priority queue: the branch whose border lies
nearest is opened next, until the leaves hold as many vectors as asked for. Leaves and the queries
that ask for them meet in one task a leaf, which ranks by the exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .embedding_dedup import usable

NEIGHBOURS = 10
TREES = 4
#: Vectors a leaf holds, about; vectors the medians are taken of; deepest tree for that sample.
LEAF, SAMPLE, MAX_DEPTH = 1024, 16_384, 12
#: Vectors looked at, as a share of all, counted once for each tree they are found in.
SEARCH = 1.4


class Forest:
    """Directions and medians; ``width`` coordinates of a vector are looked at, missing ones are 0."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.width = trees, depth, sample.shape[1]
        self.directions = rng.normal(size=(trees, self.width, depth))
        self.medians = np.zeros((trees, 1 << depth))
        for t in range(trees):
            places = sample @ self.directions[t]
            node = np.ones(len(sample), np.int64)
            for level in range(depth):
                order = np.lexsort((places[:, level], node))
                first = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
                for i in range(1 << level):
                    own = places[order[first[i]:first[i + 1]], level]
                    self.medians[t, (1 << level) + i] = np.median(own) if len(own) else 0.0
                node = 2 * node + (places[:, level] > self.medians[t, node])

    def fitted(self, vectors: list[list[float]]) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, :min(len(v), self.width)] = v[:self.width]
        return out

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each vector in each tree."""
        out = np.empty((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            places = vectors @ self.directions[t]
            node = np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                node = 2 * node + (places[:, level] > self.medians[t, node])
            out[:, t] = node
        return out

    def search(self, vector: np.ndarray, leaves: int) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of one queue over all trees, ``leaves`` of them."""
        places = np.einsum("twd,w->td", self.directions, vector).tolist()
        medians = self.medians
        queue = [(0.0, t, 1) for t in range(self.trees)]
        bottom = 1 << self.depth
        while queue and leaves > 0:
            border, t, node = heapq.heappop(queue)
            while node < bottom:
                gap = places[t][node.bit_length() - 1] - float(medians[t, node])
                near = 2 * node + (gap > 0)
                heapq.heappush(queue, (max(border, abs(gap)), t, near ^ 1))
                node = near
            yield t, node
            leaves -= 1


def nearest(
    embeddings: DataFrame, is_query: Column | str, *, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, search: float = SEARCH,
) -> DataFrame:
    """The ``k`` nearest found for each query: query_id, rank, vec_id, score.

    Queries are the rows for which ``is_query``, a condition on the id as ``vec_id``, is true;
    candidates are all rows with another id. Score is the Euclidean distance of the vectors as given;
    ties go to the smaller id. Rows with a null id, and vectors that are null, empty, zero or hold
    null or non-finite components, take no part; vectors are only compared at equal lengths. Equal
    rows count once; rows of one id with different vectors are queries and candidates of their own.
    With fewer candidates than ``k`` all are given; an empty table gives no rows. Of equal vectors
    the ``k + 1`` smallest ids are indexed, as no query can need more.
    """
    good = usable(f"`{vector_col}`") & F.col(f"`{id_col}`").isNotNull()
    rows = embeddings.filter(good).select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding")
    ).distinct()
    rows = cut_lineage(rows, "vectors")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    classes = cut_lineage(
        classes.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes"
    )
    total = classes.count()
    picked = classes.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE)
    sample = [r.embedding for r in picked.select("embedding").collect()]
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(total, 1) / leaf)))))
    padded = np.zeros((len(sample), max(map(len, sample), default=1)))
    for i, v in enumerate(sample):
        padded[i, :len(v)] = v
    forest = Forest(padded, trees, depth)
    visited = max(trees, int(np.ceil(search * (1 << depth))) + 1)
    shipped = rows.sparkSession.sparkContext.broadcast(forest)  # trees * 2^12 medians at most
    kind = rows.schema["embedding"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                spots = own.leaves(own.fitted(part.column("embedding").to_pylist()))
                for t in range(own.trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, t)), pa.array(spots[:, t]), part.column("ids"),
                         part.column("embedding")], names=["tree", "leaf", "ids", "embedding"],
                    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                vectors = own.fitted(part.column("embedding").to_pylist())
                found = [(i, t, n) for i, v in enumerate(vectors) for t, n in own.search(v, visited)]
                pick = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                     *(part.column(c).take(pick) for c in ("query", "vec_id", "embedding"))],
                    names=["tree", "leaf", "query", "query_id", "embedding"],
                )

    index = classes.select("ids", "embedding").mapInArrow(
        route, f"tree bigint, leaf bigint, ids array<bigint>, embedding {kind}"
    )
    queries = rows.filter(is_query).withColumn("query", F.xxhash64("vec_id", "embedding"))
    asked = queries.repartition("query").select("query", "vec_id", "embedding").mapInArrow(
        ask, f"tree bigint, leaf bigint, query bigint, query_id bigint, embedding {kind}"
    )

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(_ranked(left, right, k)) if left.num_rows and right.num_rows else []
        near = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({
            "query": pa.array([o[0] for o in out], pa.int64()), "query_id": pa.array([o[1] for o in out], pa.int64()),
            "near": pa.array([[{"score": s, "vec_id": v} for s, v in o[2]] for o in out], near),
        })

    found = index.groupBy("tree", "leaf").cogroup(asked.groupBy("tree", "leaf")).applyInArrow(
        rank, "query bigint, query_id bigint, near array<struct<score: double, vec_id: bigint>>"
    )
    # at most k pairs of each leaf visited, the leaves visited being a fixed number
    merged = found.groupBy("query", "query_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort(F.array_distinct("near")), 1, k)
    return merged.select("query_id", F.posexplode(best).alias("place", "near")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def _ranked(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[int, int, list[tuple[float, int]]]]:
    """Each query's nearest in one leaf: (query, query_id, [(distance, vec_id)])."""
    widths = pc.list_value_length(left.column("embedding")).to_numpy()
    asked = pc.list_value_length(right.column("embedding")).to_numpy()
    for width in np.intersect1d(widths, asked):
        own = left.take(pa.array(np.flatnonzero(widths == width)))
        vectors, ids = _matrix(own.column("embedding"), int(width)), own.column("ids").to_pylist()
        part = right.take(pa.array(np.flatnonzero(asked == width)))
        points = _matrix(part.column("embedding"), int(width))
        for i, (query, query_id) in enumerate(zip(part.column("query").to_pylist(), part.column("query_id").to_pylist())):
            distance = np.sqrt(((vectors - points[i]) ** 2).sum(1))
            # the query's own vector may fill one place
            limit = np.partition(distance, k)[k] if len(distance) > k + 1 else np.inf
            near = [
                (float(distance[j]), v) for j in np.flatnonzero(distance <= limit).tolist() for v in ids[j] if v != query_id
            ]
            yield query, query_id, sorted(near)[:k]
