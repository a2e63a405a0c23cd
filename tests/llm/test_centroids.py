import hashlib

import numpy as np
import pytest
from conftest import bag

from tallyshelf.llm import centroids


def brute(rows, clusters, rounds, width):
    """Lloyd's rounds in plain Python."""
    def fit(v):
        return v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)

    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if fit(v)]
    key = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() for i, _ in kept}
    seeds = sorted(kept, key=lambda r: (r[0] is None, key[r[0]], r[1]))[:clusters]
    centres = [list(v) for _, v in seeds]

    def assigned():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)))
        return out

    for _ in range(rounds if kept else 0):
        near = assigned()
        for k in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == k]
            if own:
                centres[k] = [sum(column) // len(own) for column in zip(*own)]
    near = assigned() if kept else []
    total = sum(d for d, _ in near)
    return sorted((
        (i, c, d, sum(e for e, other in near if other == c), total,
         hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, near)
    ), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, shard int, cells string")


def vectors(seed, count, width):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(count, width)))]


@pytest.mark.parametrize("width", [5, 16, 40])
def test_equals_plain_rounds(spark, width):
    rows = vectors(width, 230, width)
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # equal vectors: ties and emptied clusters
    rows += [(3, rows[5][1]), (3, rows[3][1]), (None, rows[9][1]), (400, None), (401, []), (402, [1.0] * (width - 1))]
    rows += [(403, [None] + [1.0] * (width - 1)), (404, [float("nan")] * width), (405, [float("inf")] * width), (406, [0.0] * width)]
    df = frame(spark, rows).repartition(5)
    got = centroids.clustered(df, clusters=12, rounds=4, width=width, batch=16)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 12, 4, width)


def test_empty_clusters_stay(spark):
    rows = [(i, [0.5, 0.5]) for i in range(9)] + [(9, [0.5, 0.75])]
    got = centroids.clustered(frame(spark, rows), clusters=10, rounds=3, width=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10, 3, 2)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = vectors(1, 6, 3)
    got = centroids.clustered(frame(spark, rows), clusters=10, rounds=2, width=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10, 2, 3)
    assert centroids.clustered(frame(spark, rows).limit(0), width=3).collect() == []
    assert centroids.clustered(frame(spark, [(1, None)]), width=3).collect() == []


def test_any_partitioning_gives_the_same(spark):
    df = frame(spark, vectors(2, 150, 20))
    one, many = (bag(centroids.clustered(df.repartition(n), clusters=7, rounds=3, width=20, batch=b)) for n, b in ((1, 1000), (9, 4)))
    assert one == many


def test_components_that_would_overflow_are_refused(spark):
    with pytest.raises(Exception, match="must stay below"):
        centroids.clustered(frame(spark, [(1, [1e6, 0.0])]), width=2)
