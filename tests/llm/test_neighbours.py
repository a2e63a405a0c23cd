import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import neighbours

QUERY = "vec_id % 20 = 0"


def brute(rows, k=10):
    def fit(r):
        return r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    known = {(r[0], tuple(r[1])) for r in rows if fit(r)}
    out = []
    for q, v in known:
        if q % 20 == 0:
            near = sorted({
                (float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in known if i != q and len(w) == len(v)
            })
            out += [(q, rank, i, score) for rank, (score, i) in enumerate(near[:k], 1)]
    return sorted(out)


def points(seed, count=700, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    data = centres[rng.integers(20, size=count)] + rng.normal(size=(count, width)) * 0.4
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    return rows + [(count + i, rows[40][1]) for i in range(30)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)


def close(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_all_leaves_give_the_exact_answer(spark):
    rows = points(1)
    got = neighbours.nearest(frame(spark, rows), QUERY, leaf=32, search=float(neighbours.TREES)).collect()
    close(sorted(map(tuple, got)), brute(rows))


def test_recall(spark):
    rows = points(2, 3000)
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(frame(spark, rows), QUERY, leaf=64).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows)}
    assert len(got & want) >= 0.9 * len(want)


def test_nearest_border_comes_first():
    rng = np.random.default_rng(3)
    forest = neighbours.Forest(rng.normal(size=(500, 6)), 3, 4)
    vector = rng.normal(size=6)
    found = list(forest.search(vector, 1000))
    assert len(found) == len(set(found)) == 3 * 16
    assert set(found[:3]) == {(t, n) for t, n in enumerate(forest.leaves(vector[None])[0].tolist())}


@pytest.mark.parametrize("copies", [1, 40])
def test_odd_rows(spark, copies):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 1.0]), (20, [1.0, 2.0]), (None, [1.0, 2.0]), (40, None), (60, []),
            (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [inf, 0.0]), (140, [None, 1.0]), (160, [1.0, 2.0, 3.0]), (3, [2.0, 1.0])]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(copies)]
    got = neighbours.nearest(frame(spark, rows).withColumn("leaf", F.lit(1)).withColumn("rank", F.lit("x")), QUERY).collect()

    by_query = {}
    for g in got:
        by_query.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    want = {}
    for q, rank, i, score in brute(rows):
        want.setdefault(q, []).append((rank, i, score))
    assert sorted(map(str, by_query.get(20, []))) == sorted(map(str, want[20]))
    assert 160 not in by_query and not set(by_query) & {40, 60, 80, 100, 120, 140}
    assert neighbours.nearest(frame(spark, rows).limit(0), QUERY).collect() == []
