import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import whitening


def brute(rows, components=32):
    """(n, {row place: deviation}, whitened matrix, shares) of the rows that count, by numpy and whole numbers."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    gaps = n * x - s
    centred = gaps.astype(float) / n
    variance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(variance)
    order = [i for i in np.argsort(-values) if values[i] > 1e-12 * np.trace(variance)][:components]
    return n, (gaps**2).sum(1).tolist(), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(variance)


def check(got, ids, vectors, components=32):
    n, deviation, expected, shares = brute(vectors, components)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == len(ids) * expected.shape[1]
    assert {r.n for r in got} == {n}
    assert [table[i, 1].deviation for i in ids] == deviation
    for c in range(expected.shape[1]):
        own = np.array([table[i, c + 1].whitened for i in ids])
        sign = np.sign(own @ expected[:, c])
        assert np.allclose(own * sign, expected[:, c], atol=1e-7)
        assert abs(table[ids[0], c + 1].explained / shares[c] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def data(seed, count, width):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(count, width)) * rng.uniform(0.2, 3, width) + rng.normal(size=width)).tolist()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, index int, y string")


@pytest.mark.parametrize("width", [3, 40])
def test_equals_numpy(spark, width, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)  # many blocks
    monkeypatch.setattr(whitening, "SPLIT", 2)
    vectors = data(width, 200, width)
    vectors += [vectors[4]] * 20
    rows = list(enumerate(vectors))
    odd = [(900, None), (901, []), (902, [1.0]), (903, [None] * width), (904, [float("nan")] * width), (905, [float("inf")] * width)]
    check(whitening.whitened(frame(spark, rows + odd).repartition(5)).collect(), list(range(220)), vectors)


def test_rows_of_one_id_and_without_id(spark):
    vectors = data(1, 50, 4)
    rows = [(None if i < 5 else 7 if i < 9 else i, v) for i, v in enumerate(vectors)]
    got = whitening.whitened(frame(spark, rows)).collect()
    _, deviation, _, _ = brute(vectors)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert sum(r.vec_id is None for r in got) == 20 and sum(r.vec_id == 7 for r in got) == 16


def test_flat_directions_and_empty_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]  # one direction has all the variance
    got = whitening.whitened(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and abs(got[0].explained - 1) < 1e-12
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whitened(frame(spark, rows)).collect() == []


def test_numbers_are_consecutive_whatever_the_partitions(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2).repartition(7, "id").filter("id % 3 > 0")
    got = whitening._numbered(rows).collect()
    assert sorted(r["index"] for r in got) == list(range(len(got))) and all(r.v == 2 * r.id for r in got)


def test_given_table(spark):
    from conftest import SF

    from tallyshelf.llm import registry

    source = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    check(registry.op12_whitening(spark, SF).collect(), [r.vec_id for r in source], [r.embedding for r in source])
