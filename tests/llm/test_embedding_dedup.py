import math
import random

import numpy as np
import pytest

from tallyshelf.llm import embedding_dedup
from tallyshelf.llm.components import component_roots


def brute(rows, threshold=0.98):
    def fit(r):
        v = r[1]
        return r[2] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if fit(a) and fit(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k), todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def vectors(seed, count=300, width=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        if rows and rng.random() < 0.5:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=len(base)) * rng.choice([0, 0.03, 0.06, 0.2])
        else:
            v = rng.normal(size=width) * rng.choice([0.1, 1, 50])
        rows.append((int(i), [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_against_brute_force(spark, block):
    rows = vectors(block)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = embedding_dedup.near_duplicates(frame, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_odd_rows(spark):
    one, two = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    nan, inf = float("nan"), float("inf")
    rows = [(1, one, 0), (2, two, 0), (2, two, 0), (None, one, 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [], 0),
            (7, [0.0, 0.0, 0.0], 0), (8, [nan, 1.0, 1.0], 0), (9, [inf, 1.0, 1.0], 0), (10, [1.0, None, 1.0], 0),
            (11, [1.0, 2.0], 0), (12, [-1.0, -2.0, -3.0], 0), (None, [5.0, 0.0, 0.0], 0), (13, [1e30, 2e30, 3e30], 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, row int, n int")
    got = embedding_dedup.near_duplicates(frame).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(3000)] + [(5000, [1.0, 2.0, 3.01], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    assert {(r.n_links, r.component_id) for r in got.collect()} == {(3000, 0)}


def test_components(spark):
    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
                  [(0, i) for i in range(1, 50)], []):
        root = {}
        for a, b in edges:
            if a != b:
                for x in (a, b):
                    root.setdefault(x, x)
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if a != b and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
        frame = spark.createDataFrame(edges, "a bigint, b bigint")
        assert {r.node: r.root for r in component_roots(frame).collect()} == root
