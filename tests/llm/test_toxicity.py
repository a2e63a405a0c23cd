import itertools
import zlib

import numpy as np
import pytest

from tallyshelf.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def phi(word, stem=False):
    marked = bytes([toxicity.FRONT]) + word + (b"" if stem else bytes([toxicity.BACK]))
    out, norm = {}, 0.0
    for i, j, k in itertools.combinations(range(len(marked)), 3):
        if k - i <= toxicity.SPAN:
            w = toxicity.DECAY ** (k - i + 1)
            u = (marked[i], marked[j], marked[k])
            out[u] = out.get(u, 0) + w
            norm += w * w
    return out, norm ** 0.5


def kernel(word, landmark):
    stem = landmark.endswith(b"*")
    (a, n), (b, m) = phi(word), phi(landmark.rstrip(b"*"), stem)
    return (sum(v * b.get(u, 0) for u, v in a.items()) / (n * m)) ** toxicity.POWER


def machine(names):
    rows, table = toxicity._landmark_triples(names)
    count = len(names)
    return toxicity.Machine(names, rows, table, np.eye(count), np.ones(count), 0.0, 1.0, 0.0)


def test_kernel_against_brute_force():
    names = [b"idiot", b"scum", "chón".encode() + b"*", b"aa"]
    words = ["idiot", "idiiot", "i", "id.iot", "scumbag", "chónto", "aaaa", "aa", "the", "chón"]
    got = machine(names).text_likeness(words)
    for i, w in enumerate(words):
        assert np.allclose(got[i], [kernel(w.encode(), n) for n in names], atol=1e-5)


def test_text_takes_its_most_alike_word():
    own = machine([b"idiot", b"scum"])
    texts = ["the idiot", "(Idiot), scum.", "", "...", None or "", "of the"]
    got = own.text_likeness(texts)
    idiot, scum = kernel(b"idiot", b"idiot"), kernel(b"scum", b"scum")
    assert np.allclose(got[0, 0], idiot, atol=1e-5) and np.allclose(got[1], [idiot, scum], atol=1e-5)
    assert (got[2:5] == 0).all() and (got[5] < 0.1).all()
    assert own.text_likeness(["x" * 1000 + "idiot" + "y" * 1000])[0, 0] > 0
    inserted, other = own.text_likeness(["id-iot", "nothing"])[:, 0]
    assert inserted > 5 * other


def test_pieces_cover_long_words():
    first, last, word = toxicity.pieces(np.array([0, 10, 10, 50]), np.array([5, 10, 42, 150]))
    spans = {w: [(b, e) for b, e, x in zip(first, last, word) if x == w] for w in range(4)}
    assert spans[0] == [(0, 5)] and spans[1] == [] and spans[2] == [(10, 42)]
    assert spans[3][0][0] == 50 and spans[3][-1][1] == 150
    assert all(b2 < e1 for (_, e1), (b2, _) in zip(spans[3], spans[3][1:]))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_accuracy(tables):
    documents, labels = tables
    got = {r.doc_id: r for r in toxicity.fit_and_predict(documents, labels).collect()}
    assert len(got) == documents.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and sum(g.held_out for g in got.values()) < len(got)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())


def test_odd_rows(spark, tables):
    own = toxicity.train([("an idiot", 1)] * 100 + [("old scum", 1)] * 100 + [("an old nice day", 0)] * 300)
    rows = [(1, None), (2, ""), (None, "such an idiot"), (3, "an idiot and scum"), (3, "a nice day"), (4, "?!. ,"), (5, "z" * 90_000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, score int")
    got = {}
    for r in toxicity.predict(docs, own).collect():
        got.setdefault(r.doc_id, []).append(r.predicted)
    assert got[None] == [1] and sorted(got[3]) == [0, 1] and got[1] == got[2] == got[4] == got[5] == [0]
    assert toxicity.predict(docs.limit(0), own).collect() == []


def test_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    for samples, want in (([], 0), ([("x", 0)], 0), ([("x", 1)], 1)):
        assert [r.predicted for r in toxicity.predict(docs, toxicity.train(samples)).collect()] == [want]
    labels = spark.createDataFrame([(1, None), (1, 0), (1, 1), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.training_rows(docs, labels, "true") == [("a b", 1)]


def test_few_labels_still_find_insults():
    clean = [(f"a nice day number {i} in town", 0) for i in range(150)]
    toxic = [(f"a nice {w} number {i} in town", 1) for i, w in enumerate(["idiot", "scum", "moron", "clown", "loser"] * 2)]
    own = toxicity.train(clean + toxic)
    assert {b"idiot", b"scum", b"moron", b"clown", b"loser"} <= {n.rstrip(b"*") for n in own.names}
    scores = own.scores(["what an idiot", "the scum", "a moron", "that clown", "a loser", "a nice day", "day in town"])
    assert (scores[:5] >= 0.5).all() and (scores[5:] < 0.5).all()


def test_short_words_keep_longer_ones():
    samples = [("ab abide idiot", 1)] * 40 + [("some words", 0)] * 40
    assert {n.rstrip(b"*") for n in toxicity.train(samples).names} == {b"ab", b"abide", b"idiot"}


def test_disguised_insults():
    own = toxicity.train([("an idiot", 1)] * 100 + [("old scum", 1)] * 100 + [("an old nice day", 0)] * 300)
    scores = own.scores(["an id-iot and sc.um", "an i.diot", "idio_t", "old s*cum", "an old day", "a nice day"])
    assert (scores[:4] >= 0.5).all() and (scores[4:] < 0.5).all()


def test_recall_and_precision_apart(tables):
    documents, labels = tables
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.predicted, truth[r.doc_id]) for r in toxicity.fit_and_predict(documents, labels).collect()
            if r.held_out and r.doc_id in truth]
    found = sum(p == t == 1 for p, t in rows)
    assert found >= 0.85 * sum(t for _, t in rows)
    assert found >= 0.5 * sum(p for p, _ in rows)


def test_memo_changes_nothing_and_is_bounded(monkeypatch):
    import pickle

    monkeypatch.setattr(toxicity, "MEMO", 20)
    texts = [" ".join(f"word{(i * j) % 41}" for j in range(1, 12)) + " idiot" * (i % 2) for i in range(60)]
    own = machine([b"idiot", b"word4*"])
    plain = []
    for text in texts:
        own.__dict__.pop("memo", None)
        plain.append(own.text_likeness([text])[0])
    own.__dict__.pop("memo", None)
    kept = np.concatenate([own.text_likeness(texts[i:i + 7]) for i in range(0, 60, 7)])
    assert np.array_equal(kept, np.array(plain))
    assert len(own.memo[0]) == len(own.memo[2]) == 20 and np.all(np.diff(own.memo[0].astype(object)) > 0)
    assert "memo" not in pickle.loads(pickle.dumps(own)).__dict__
