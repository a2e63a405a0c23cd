"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors within an angle are within a distance, ``epsilon``. Their coordinates along the leading
principal directions are cut into cells of that width, and vectors are put in the order of their
cells. Vectors whose cells differ by more than one in any coordinate are too far apart, so two
intervals of the sequence whose cell boxes are apart need no look. Intervals are joined recursively:
halves against halves, down to blocks, whose pairs are compared by matrix products.

Equal vectors count as one with a multiplicity, and a pair of blocks gives sums and a spanning forest,
never the pairs themselves.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .components import component_roots, forest

THRESHOLD = 0.98
DIRECTIONS = 6
#: Vectors the principal directions are fitted on; they steer the order, not the result.
SAMPLE = 4096
BLOCK, FAN = 512, 64


def usable(vector: str) -> F.Column:
    """Not null, not zero, all components finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_directions(sample: list[list[float]], count: int) -> np.ndarray:
    """Orthonormal columns, leading first, of unit vectors padded to the longest of the sample."""
    if not sample:
        return np.zeros((0, 0))
    width = max(map(len, sample))
    data = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        data[i, :len(v)] = v
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(np.cov(data.T).reshape(width, width) if len(sample) > 1 else np.eye(width))
    return np.ascontiguousarray(vectors[:, ::-1][:, :count])


def _units(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(over="ignore"):
        flat = flat / np.abs(flat).max(1, keepdims=True)  # keeps squares of huge numbers finite
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> bool:
    """Whether two boxes of cells differ by more than one cell in some coordinate."""
    return bool(((low2 > high + 1) | (low > high2 + 1)).any())


def joined_blocks(left: tuple, right: tuple, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs of blocks of two sequence intervals, each (ids, low, high), that may hold links."""
    ids, low, high = left
    ids2, low2, high2 = right
    if apart(low.min(0), high.max(0), low2.min(0), high2.max(0)):
        return
    if len(ids) == 1 and len(ids2) == 1:
        yield int(ids[0]), int(ids2[0])
        return
    m, m2 = (len(ids) + 1) // 2, (len(ids2) + 1) // 2
    halves = [tuple(x[:m] for x in left), tuple(x[m:] for x in left)]
    halves2 = [tuple(x[:m2] for x in right), tuple(x[m2:] for x in right)]
    for i, a in enumerate(halves):
        for j, b in enumerate(halves2):
            if len(a[0]) and len(b[0]) and not (same and i > j):
                yield from joined_blocks(a, b, same and i == j)


def _blocks(vectors: DataFrame, directions: np.ndarray, epsilon: float, block: int) -> DataFrame:
    """Runs of the grid order: (block, label, width, low, high, data), data packs ids, counts, vectors."""
    count = directions.shape[1]
    cells = [F.col("cells")[i] for i in range(count)]

    def place(batches):
        for batch in batches:
            widths = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, count), np.int32)
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                units = _units(batch.column("embedding").take(pa.array(rows)), int(width))
                shared = min(int(width), len(directions))
                # a part of the coordinates is never farther apart than the whole
                out[rows] = np.floor(units[:, :shared] @ directions[:shared] / epsilon)
            flat = pa.ListArray.from_arrays(np.arange(0, out.size + 1, count, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "n", "label", "embedding")), flat],
                names=["row", "n", "label", "embedding", "cells"],
            )

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = vectors.mapInArrow(place, f"row bigint, n bigint, label int, embedding {kind}, cells array<int>")
    placed = placed.withColumn("width", F.size("embedding"))
    order = ["label", "width", *cells, "row"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        held: list[dict] = []

        def row():
            units = _units(pa.array([h["embedding"] for h in held], pa.list_(pa.float64())), held[0]["width"])
            grid = np.array([h["cells"] for h in held], np.int32).reshape(len(held), count)
            data = pickle.dumps(([h["row"] for h in held], [h["n"] for h in held], units), protocol=5)
            return pa.RecordBatch.from_pylist([{
                "block": held[0]["row"], "label": held[0]["label"], "width": held[0]["width"],
                "low": grid.min(0).tolist(), "high": grid.max(0).tolist(), "data": data,
            }], schema=schema)

        schema = pa.schema([
            ("block", pa.int64()), ("label", pa.int32()), ("width", pa.int32()),
            ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("data", pa.binary()),
        ])
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == block or (held[0]["label"], held[0]["width"]) != (r["label"], r["width"])):
                    yield row()
                    held = []
                held.append(r)
        if held:
            yield row()

    return cut_lineage(
        placed.mapInArrow(cut, "block bigint, label int, width int, low array<int>, high array<int>, data binary"),
        "blocks",
    )


def _block_pairs(blocks: DataFrame, count: int, fan: int) -> DataFrame:
    """(a, b) of blocks that may hold links, from intervals of ``fan`` blocks that may."""
    cells = [F.col("low")[i] for i in range(count)]
    order = ["label", "width", *cells, "block"]
    metas = blocks.select("block", "label", "width", "low", "high")
    metas = metas.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = "id bigint, label int, width int, low array<int>, high array<int>, data binary"
    schema = pa.schema([
        ("id", pa.int64()), ("label", pa.int32()), ("width", pa.int32()),
        ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("data", pa.binary()),
    ])

    def gather(batches):
        held: list[dict] = []

        def row():
            part = tuple(np.array([h[c] for h in held]) for c in ("block", "low", "high"))
            return pa.RecordBatch.from_pylist([{
                "id": held[0]["block"], "label": held[0]["label"], "width": held[0]["width"],
                "low": part[1].min(0).tolist(), "high": part[2].max(0).tolist(), "data": pickle.dumps(part),
            }], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == fan or (held[0]["label"], held[0]["width"]) != (r["label"], r["width"])):
                    yield row()
                    held = []
                held.append(r)
        if held:
            yield row()

    intervals = cut_lineage(metas.mapInArrow(gather, fields), "intervals")
    near = [F.lit(True)]
    for i in range(count):
        near.append((F.col("l.low")[i] <= F.col("r.high")[i] + 1) & (F.col("r.low")[i] <= F.col("l.high")[i] + 1))
    condition = (F.col("l.label") == F.col("r.label")) & (F.col("l.width") == F.col("r.width"))
    condition &= F.col("l.id") <= F.col("r.id")
    left, right = intervals.alias("l"), intervals.alias("r")
    if count:  # cells of the leading coordinate, and the next ones, meet
        left = intervals.withColumn("cell", F.explode(F.sequence(F.col("low")[0] - 1, F.col("high")[0] + 1))).alias("l")
        right = intervals.withColumn("cell", F.explode(F.sequence(F.col("low")[0], F.col("high")[0]))).alias("r")
        first = F.greatest(F.col("l.low")[0] - 1, F.col("r.low")[0])  # each pair once
        condition &= (F.col("l.cell") == F.col("r.cell")) & (F.col("l.cell") == first)
    for n in near:
        condition &= n
    pairs = left.join(right, condition).select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.data").alias("x"), F.col("r.data").alias("y")
    )

    def expand(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = list(joined_blocks(pickle.loads(r["x"]), pickle.loads(r["y"]), r["a"] == r["b"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"]
                )

    return pairs.mapInArrow(expand, "a bigint, b bigint")


def near_duplicates(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, block: int = BLOCK, directions: int = DIRECTIONS,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows with equal labels link if the cosine of their vectors is at least ``threshold``. Rows with a
    null label, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing; so do vectors of different lengths. ``component_id`` is the smallest id reachable,
    null ids last; ``kept`` says whether it is the row's own. Rows that share an id count each. An
    empty table gives no rows. Other columns are not read.
    """
    rows = cut_lineage(
        embeddings.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("vec_id"),
            F.col(f"`{label_col}`").cast("int").alias("label"), F.col(f"`{vector_col}`").alias("embedding"),
            (usable(f"`{vector_col}`") & F.col(f"`{label_col}`").isNotNull()).alias("fit"),
        ),
        "vectors",
    )
    fit = rows.filter("fit")
    classes = cut_lineage(
        fit.groupBy("label", "embedding").agg(
            F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")
        ),
        "classes",
    )
    sample = classes.select("embedding", F.xxhash64("embedding").alias("h"), "row").orderBy("h", "row").limit(SAMPLE)
    axes = principal_directions([r.embedding for r in sample.select("embedding").collect()], directions)
    epsilon = float(np.sqrt(2 - 2 * threshold) * (1 + 1e-6) + 1e-9)
    blocks = _blocks(classes.select("row", "n", "label", "embedding"), axes, epsilon, block)
    pairs = _block_pairs(blocks, axes.shape[1], FAN)
    data = blocks.select("block", "data")
    loaded = pairs.join(data.withColumnsRenamed({"block": "a", "data": "x"}), "a").join(
        data.withColumnsRenamed({"block": "b", "data": "y"}), "b"
    )

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids, n, u = pickle.loads(r["x"])
                same = r["a"] == r["b"]
                ids2, n2, v = (ids, n, u) if same else pickle.loads(r["y"])
                linked = u @ v.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                ids, n, ids2, n2 = map(np.array, (ids, n, ids2, n2))
                sums, sums2 = linked @ n2, linked.T @ n
                left, right = np.nonzero(linked)
                shift = 0 if same else len(ids)
                tree = forest(len(ids) + (0 if same else len(ids2)), left, right + shift)
                has = np.flatnonzero(sums)
                has2 = np.flatnonzero(sums2) if not same else has[:0]
                node = np.concatenate([ids[has], ids2[has2], ids[left[tree]]])
                count = np.concatenate([sums[has], sums2[has2], np.zeros(len(tree), np.int64)])
                other = np.concatenate([np.full(len(has) + len(has2), -1), ids2[right[tree]]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(count, pa.int64())],
                    names=["a", "b", "n"],
                )

    found = cut_lineage(loaded.mapInArrow(compare, "a bigint, b bigint, n bigint"), "links")
    links = found.filter("b < 0").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "row")
    roots = component_roots(found.filter("b >= 0").select("a", "b")).withColumnRenamed("node", "row")
    known = classes.join(roots, "row", "left").join(links, "row", "left")
    known = known.withColumn("root", F.coalesce("root", "row"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(smallest, "root").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"
    )
    linked = fit.join(known, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
