import random
import re

import numpy as np
import pytest

from tallyshelf.llm import jaccard
from tallyshelf.llm.chunks import bits_of, sent_widths, widths_elsewhere
from tallyshelf.llm.count_tree import CountTree, candidates, count_vector, groups_for, needed


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)] = min(least.get(root(i), ident), ident)
    return sorted(((rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 4, 5, 8, 30, 90, 250]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            if rng.random() < 0.2:
                text += "\n" + passage
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "buckets_for", lambda chunks: 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard.similar_rows(docs, chunk_bytes=6000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    leaders = [r.component_id for r in got if r.leader]
    assert len(leaders) == len(set(leaders)) and set(leaders) == {r.component_id for r in got}


@pytest.mark.parametrize("block,task_rows", [(512, 32_768), (3, 20)])
def test_links_across_blocks_are_found(spark, monkeypatch, block, task_rows):
    """With blocks that find nothing, the prefixes alone must find every link."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TASK_ROWS", task_rows)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(jaccard, "_blocks", lambda sets, percent: none)
    got = jaccard.similar_rows(docs, chunk_bytes=6000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_prefixes_are_rare_and_shared_by_similar_sets():
    rng = np.random.default_rng(6)
    line = rng.integers(0, 2**63, 30, dtype=np.uint64)  # in every set
    sets = []
    for n in (40, 60, 100):
        base = np.append(rng.integers(0, 2**63, n, dtype=np.uint64), line)
        for _ in range(6):
            sets.append(np.unique(np.append(base[rng.random(len(base)) > 0.05], rng.integers(0, 2**63, 3, dtype=np.uint64))))
    doc, value = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    names, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
    owner, held = jaccard.prefixes_of(doc, value, bits_of(counts)[inverse], 75)
    assert not set(held.tolist()) & set(line.tolist()) and (counts[np.searchsorted(names, held)] > 1).all()
    own = [set(held[owner == i].tolist()) for i in range(len(sets))]
    met = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.similar(sets[i], sets[j], 75)]
    assert len(met) > 20 and all(own[i] & own[j] for i, j in met)


def test_widths_count_chunks(spark):
    """Every chunk learns in how many chunks each of its codes is; a code of one chunk only has width 0."""
    held = {0: [1, 2, 3, 9 << 32], 1: [2, 3], 2: [3, 7], 3: [3, 9 << 32], 4: [3]}
    plain = spark.createDataFrame([(k, [0], [0], b"") for k in held], "chunk bigint, ids array<bigint>, sizes array<bigint>, data binary")
    mail = widths_elsewhere(plain, lambda chunk: np.array(held[chunk["chunk"]], np.uint64))
    rows = mail.collect()
    assert len(rows) <= sum(map(len, held.values()))
    for chunk, codes in held.items():
        sent = [bytes(r.payload) for r in rows if r.chunk == chunk]
        want = [sum(c in other for other in held.values()) for c in codes]
        assert sent_widths(np.array(codes, np.uint64), sent).tolist() == [n.bit_length() if n > 1 else 0 for n in want]


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(20_000))
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n"), (5, "A B"), (6, "a b"),
            (7, "a b c"), (8, long), (9, long + " tail"), (None, "z z z z z z z"), (10, None), (11, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, node int, shingles string")
    got = jaccard.similar_rows(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert sum(r.leader for r in got) == 1 + 4 + 1 + 1 + 1 + 1 + 1
    assert jaccard.similar_rows(docs.limit(0)).collect() == []


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.choice([1, 6, 40, 300]), dtype=np.uint64))
        for _ in range(3):
            sets.append(np.unique(np.append(base[rng.random(len(base)) > 0.08], rng.integers(0, 2**63, 2, dtype=np.uint64))))
    sizes = np.array([len(s) for s in sets])
    vectors = [count_vector(s, groups_for(len(s))) for s in sets]
    near = {i: set(found.tolist()) for i, found in candidates(vectors, sizes, 75)}
    met = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if jaccard.similar(a, b, 75):
                met += 1
                assert j in near[i] and i in near[j]
    assert met > 60 and sum(map(len, near.values())) < len(sets) ** 2 / 4


def test_tree_search():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 6, (300, 16)).astype(np.int32)
    sizes = points.sum(1)
    tree = CountTree(points, sizes)
    for k in range(40):
        bound = np.minimum(points, points[k]).sum(1)
        least = -(-sizes[k] * 75 // 100)
        want = np.flatnonzero(bound >= needed(sizes[k], sizes, 75))
        got = tree.search(points[k], int(sizes[k]), 75)
        assert set(got) <= set(want) and set(want[sizes[want] >= least]) <= set(got)
