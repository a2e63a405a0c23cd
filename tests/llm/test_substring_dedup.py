import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyshelf.llm import substring_dedup
from tallyshelf.llm.fm_index import Bits, FmIndex, WaveletTree
from tallyshelf.llm.words import word_borders, word_hashes


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=300))
def test_ranks(symbols):
    symbols = np.array(symbols, np.int64)
    tree = WaveletTree(symbols, 9)
    for c in range(9):
        at = np.arange(len(symbols) + 1)
        want = np.concatenate([[0], np.cumsum(symbols == c)])
        assert (tree.rank(np.full(len(at), c), at) == want).all()
    ones = Bits(symbols > 4).rank(np.arange(len(symbols) + 1))
    assert (ones == np.concatenate([[0], np.cumsum(symbols > 4)])).all()


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=10), min_size=1, max_size=7),
    st.lists(st.integers(0, 4), max_size=25),
)
def test_matching_statistics(strings, stream):
    sizes = np.array([len(s) for s in strings])
    index = FmIndex(np.array(sum(strings, [])), sizes, 5)
    begins = np.arange(len(stream))
    length, low, high = index.matches(np.array(stream, np.int64), begins, len(stream) - begins)

    def holders(part):
        return sorted(d for d, s in enumerate(strings) for j in range(len(s)) if s[j:j + len(part)] == part)

    for i in range(len(stream)):
        want = max(n for n in range(len(stream) - i + 1) if n == 0 or holders(stream[i:i + n]))
        assert length[i] == want
        if want:
            assert sorted(index.owner[low[i]:high[i]].tolist()) == holders(stream[i:i + want])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t\x0b\x1cé", max_size=12).map(str.encode), max_size=6))
def test_word_borders(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, end, counts = word_borders(data, np.array([len(t) for t in texts], np.int64))
    raw = data.tobytes()
    words = [w for t in texts for w in t.split()]
    assert [raw[b:e] for b, e in zip(begin, end)] == words
    assert counts.tolist() == [len(t.split()) for t in texts]
    hashed = word_hashes(data, begin, end).tolist()
    assert len(set(hashed)) == len(set(words)) and len(set(zip(hashed, words))) == len(set(words))


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    ids = [-(2**63) if r[0] is None else r[0] for r in rows]
    least = {}
    for i, own in zip(ids, words):
        for p in range(len(own) - window + 1):
            w = tuple(own[p:p + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for row, i, own in zip(rows, ids, words):
        gone = [False] * len(own)
        for p in range(len(own) - window + 1):
            if least[tuple(own[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((row[0], len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "éa", "tion", "ßung", "The", "|", "on,"]
    passages = [rng.choices(words, k=rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else rng.choices(words, k=rng.randint(0, 30))
        rows.append((rng.randint(0, 45), rng.choice([" ", "  ", "\n", "\t "]).join(parts)))
    return rows + [(50, "a " * 300), (51, "b " + "a " * 90), (51, "a " * 90), (52, "x y " * 50), (53, "y x " * 50)]


@pytest.mark.parametrize("window", [13, 4])
def test_against_brute_force(spark, window, monkeypatch):
    rows = corpus(window)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "buckets_for", lambda chunks: 3)
    got = substring_dedup.repeat_digests(docs, window=window, chunk_bytes=1500).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(None, "z " * 20, 1, "x"), (1, "z " * 20, 2, None), (1, None, None, "y"), (2, "", 3, "x"), (3, long, 4, "x"),
            (3, long, 4, "x"), (4, long, 5, "x"), (5, "q " * 12, 5, "x"), (6, "q " * 12, 5, "x"), (None, "z " * 20, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk int, bucket string")
    got = sorted(map(tuple, substring_dedup.repeat_digests(docs).collect()), key=repr)
    assert got == brute([r[:2] for r in rows], 13)
    texts = {hashlib.sha256(r.text.encode()).hexdigest() for r in substring_dedup.without_repeats(docs).collect()}
    assert texts == {g[3] for g in got}
    assert substring_dedup.repeat_digests(docs.limit(0)).collect() == []


def test_common_line_is_dealt_out_by_window(spark, monkeypatch):
    rng = random.Random(5)
    own = lambda n: " ".join(rng.choices("abcdefgh", k=n))
    line = own(18)
    rows = [(i, f"{own(rng.randint(0, 15))} {line} {own(rng.randint(0, 15))}") for i in range(60)]
    rows += [(i + 60, f"{rows[i][1]} {line}") for i in range(10)] + [(None, line), (3, f"{line} {line}"), (70, None), (70, own(40))]
    mail = []
    plain_way = substring_dedup.per_bucket
    monkeypatch.setattr(substring_dedup, "per_bucket", lambda mailbox, run: (mail.append(mailbox), plain_way(mailbox, run))[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = substring_dedup.repeat_digests(docs, crowd=8, chunk_bytes=1000)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 13)
    segments, windows = {}, 0
    for r in mail[0].collect():
        part = substring_dedup.unpack(r.payload)
        if len(part) == 7:
            for k in part[0].tolist():
                segments[k] = segments.get(k, 0) + 1
        windows += len(part[0]) if len(part) == 3 else 0
    assert windows and max(segments.values(), default=0) <= 8
