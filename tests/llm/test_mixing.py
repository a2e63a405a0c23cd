"""Mixing: against a plain loop, and rows of every kind."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tallyshelf.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, _id string, _epoch int, _src string, _times int"


def words(text):
    return len((text or "").split(" ")) if (text or "").strip() else 0


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; whoever is above its limit stops there and the rest is dealt anew, until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "own", 7, "mine", 9) for i, t, s in rows], SCHEMA).repartition(5)


def check(spark, rows):
    got = mixing.mix_table(frame(spark, rows)).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += words(text)
    want = targets(size)
    assert sorted((repr(r.doc_id), repr(r.source), r.size) for r in got) == sorted((repr(i), repr(s), words(t)) for i, t, s in rows)
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.times * r.size and 0 <= r.times <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, total in want.items():
        assert abs(taken[source] - total) <= largest[source] / 2 + 1e-6
    return got


def test_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "abc"[i % 7 % 3]) for i in range(300)]
    got = check(spark, rows)
    again = mixing.mix_table(frame(spark, rows[::-1]).repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_capped_sources_and_what_they_leave(spark):
    rows = [(i, "w " * 4 + "w", "tiny") for i in range(3)] + [(10 + i, "w w", "big") for i in range(200)]
    rows += [(500 + i, "w " * 9 + "w", "Alpha") for i in range(2)] + [(600 + i, "w", "ä") for i in range(30)]
    got = check(spark, rows)
    assert {r.times for r in got if r.source in ("Alpha",)} == {3}


def test_nulls_ties_repeats_and_texts_without_words(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t ", "b"), (None, "x y", None), (None, "x y z", "a"), (4, "q " * 50_000 + "q", "a")]
    rows += [(7, "one two", "b"), (7, "one two", "b"), (7, "three", "b"), (8, "u v", None)]
    check(spark, [r if r[1] != " \t " else (3, "", "b") for r in rows])
    empty = mixing.mix_table(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(r.target, r.taken) for r in empty} == {(0.0, 0)}
    assert mixing.mix_table(frame(spark, rows).limit(0)).collect() == []


def test_order_is_random_by_hash(spark):
    rows = [(i, "w w w w", "one" if i % 10 else "two") for i in range(400)]
    got = {r.doc_id: r.times for r in mixing.mix_table(frame(spark, rows)).collect()}
    key = {i: hashlib.md5(f"mix:{i}".encode()).hexdigest() for i, _, s in rows if s == "one"}
    turns = [got[i] for i in sorted(key, key=key.get)]
    assert turns == sorted(turns, reverse=True) and len(set(turns)) == 2


def test_rows_come_as_often_as_taken_with_their_columns(spark):
    rows = [(i, f"w{i} w w", "ab"[i % 4 == 0]) for i in range(80)]
    docs = frame(spark, rows)
    times = {r.doc_id: r.times for r in mixing.mix_table(docs).collect()}
    mixed = mixing.mixed(docs)
    found = mixed.collect()
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in found) == {i: n for i, n in times.items() if n}
    assert {(r._id, r._epoch, r._src, r._times) for r in found} == {("own", 7, "mine", 9)}
    assert all(r.text == f"w{r.doc_id} w w" for r in found)
    assert mixing.mixed(docs.limit(0)).collect() == []
