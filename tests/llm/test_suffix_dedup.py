import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyshelf.llm import suffix_dedup
from tallyshelf.llm.suffixes import shared_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 3))
def test_suffix_array(symbols, times):
    symbols = symbols * times
    order = suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_shared_prefixes():
    import numpy as np

    symbols = [2, 1, 2, 1, 0, 2, 1]
    order = suffix_array(symbols)
    got = shared_prefixes(np.array(symbols), np.array(order), 3).tolist()

    def common(a, b):
        n = 0
        while max(a, b) + n < len(symbols) and symbols[a + n] == symbols[b + n]:
            n += 1
        return min(n, 3)

    assert got == [0, *(common(a, b) for a, b in zip(order, order[1:]))]


def brute(rows, window):
    """rows (id, text) in stored order -> {row: flags of removed bytes}."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, flags = set(), {}
    for r in order:
        data = (rows[r][1] or "").encode()
        own = [False] * len(data)
        for p in range(len(data) - window + 1):
            part = data[p:p + window]
            if part in seen:
                own[p:p + window] = [True] * window
            seen.add(part)
        flags[r] = own
    return flags


def digest(row, own):
    data = (row[1] or "").encode()
    kept = bytes(b for b, gone in zip(data, own) if not gone)
    spans = sum(1 for i, gone in enumerate(own) if gone and (i == 0 or not own[i - 1]))
    return (row[0], len(data), sum(own), spans, hashlib.sha256(kept).hexdigest())


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "éa", "tion", "ßung", "it", "漢字", "on", "was"]
    passages = [" ".join(rng.choices(words, k=rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 40)))
                 for _ in range(rng.randint(0, 5))]
        text = rng.choice(["\n", " ", ""]).join(parts)
        if rng.random() < 0.3 and text:
            cut = rng.randrange(len(text))
            text = text[:cut] + "x" + text[cut + 1:]
        rows.append((i, text))
    return rows + [(60, "a" * 700), (61, "b" + "a" * 300), (62, "ab" * 200), (63, "")]


@pytest.mark.parametrize("window", [100, 40])
def test_against_brute_force(spark, window, monkeypatch):
    rows = corpus(window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    monkeypatch.setattr(suffix_dedup, "buckets_for", lambda chunks: 3)
    got = sorted(map(tuple, suffix_dedup.repeat_digests(docs, window=window, chunk_bytes=4000).collect()))
    flags = brute(rows, window)
    assert got == sorted(digest(rows[r], own) for r, own in flags.items())
    spans = {r.doc_id: r for r in suffix_dedup.repeat_spans(docs, window=window, chunk_bytes=4000).collect()}
    for r, own in flags.items():
        covered = [i for b, e in zip(spans[r].begins, spans[r].ends) for i in range(b, e)]
        assert covered == [i for i, gone in enumerate(own) if gone]


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, shared ids, clashing columns."""
    long = "lorem ipsum dolor " * 4000
    rows = [(None, "z" * 150, 1, "x"), (1, "z" * 150, 2, None), (1, None, None, "y"), (2, "", 3, "x"),
            (3, long, 4, "x"), (3, long, 4, "x"), (4, "q" * 99, 5, "x"), (5, "q" * 99, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk int, _rest string").coalesce(1)
    got = sorted(map(tuple, suffix_dedup.repeat_digests(docs).collect()), key=repr)
    flags = brute([(r[0], r[1]) for r in rows], 100)
    assert got == sorted((digest(rows[r], own) for r, own in flags.items()), key=repr)

    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    texts = sorted(((r.doc_id, r.text, r.chunk, r._rest) for r in kept.collect()), key=repr)
    want = []
    for r, own in flags.items():
        text = None if rows[r][1] is None else "".join(c for c, gone in zip(rows[r][1], own) if not gone)
        want.append((rows[r][0], text, rows[r][2], rows[r][3]))
    assert texts == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.repeat_digests(docs).collect() == []
    assert suffix_dedup.without_repeats(docs).collect() == []


def lined(seed=4):
    """Texts with a common line between their own words, some of them copies."""
    rng = random.Random(seed)
    own = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    line = own(150)
    rows = [(i, own(rng.randint(0, 90)) + line + own(rng.randint(0, 90))) for i in range(60)]
    return rows + [(i + 60, rows[i][1] + line[:120]) for i in range(10)] + [(None, line), (3, line), (70, None), (70, own(200))]


def test_common_line_is_dealt_out_by_window(spark, monkeypatch):
    mail = []
    plain_way = suffix_dedup.per_bucket
    monkeypatch.setattr(suffix_dedup, "per_bucket", lambda mailbox, run: (mail.append(mailbox), plain_way(mailbox, run))[1])
    rows = lined()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = suffix_dedup.repeat_digests(docs, crowd=8, chunk_bytes=2000)
    flags = brute(rows, 100)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digest(r, flags[i]) for i, r in enumerate(rows)), key=repr)
    segments, windows = {}, 0
    for r in mail[0].collect():
        part = suffix_dedup.unpack(r.payload)
        if len(part) == 6:
            for k in part[0].tolist():
                segments[k] = segments.get(k, 0) + 1
        windows += len(part[0]) if len(part) == 3 else 0
    assert windows and max(segments.values(), default=0) <= 8
