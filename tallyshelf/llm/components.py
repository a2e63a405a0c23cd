"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """(a, b) edges of long ids -> (node, root): the smallest id each node reaches; only nodes with edges.

    Every round hangs the larger neighbours of a node on the smallest one (large star), then the
    smaller ones (small star), until all edges point at roots. A node with very many neighbours is
    met as one pre-aggregated minimum. Each round's edges are a written table.
    """
    edges = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(hung.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def forest(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indexes of links that join parts not joined before: at most ``count - 1`` of them."""
    parent = list(range(count))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)
