import itertools
import zlib

import numpy as np
import pytest
from conftest import SF

from tallyshelf.llm import language


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    labels, counts = 3, np.array([4, 0, 1, 3])
    scores = rng.normal(size=(counts.sum(), labels))
    moves, starts = rng.normal(size=(labels, labels)), rng.normal(size=labels)
    belief, joint, first = language.forward_backward(scores, counts, moves, starts)
    want, want_joint, want_first, at = np.zeros_like(scores), np.zeros((labels, labels)), np.zeros(labels), 0
    for n in counts:
        paths = list(itertools.product(range(labels), repeat=int(n))) if n else []
        weight = np.array([
            np.exp(starts[p[0]] + sum(scores[at + t, k] for t, k in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
            for p in paths
        ])
        for p, w in zip(paths, weight / weight.sum() if n else weight):
            want_first[p[0]] += w
            for t, k in enumerate(p):
                want[at + t, k] += w
            for a, b in zip(p, p[1:]):
                want_joint[a, b] += w
        at += n
    assert np.allclose(belief, want) and np.allclose(joint, want_joint) and np.allclose(first, want_first)


def test_features_of_a_word():
    data, begin, end, _ = language.word_arrays(["abc abc de"])
    hashed = language.word_hashes(data, begin, end)
    lexicon = np.unique(hashed[:1])
    number, count = language.features(data, begin, end, hashed, lexicon)
    assert count.tolist() == [10, 10, 3 + 2 + 1]  # ^abc$: 4 pairs, 3 triples, 2 fours, itself
    assert number[:10].tolist() == number[10:20].tolist() and (number == language.BUCKETS).sum() == 2


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    got = {r.doc_id: r for r in language.fit_and_predict(documents).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())


@pytest.fixture(scope="module")
def field(documents):
    return language.train(language.training_rows(documents, "true", rows=60))


def test_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "123 | 45 %"), (None, "der die und das ist nicht"), (5, "the of and that is"),
            (5, "the of and that is"), (6, "x"), (7, "und der " * 9000), (8, "|" * 5000 + " de la que")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, lang_pred string, score int")
    got = sorted(map(tuple, language.predict(docs, field).collect()), key=repr)
    assert len(got) == len(rows)
    named = {g[0]: g for g in got}
    assert all(named[i][1:] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert named[None][1] == "de" and named[7][1] == "de" and named[5][1] == "en"
    assert language.predict(docs.limit(0), field).collect() == []
    kept = language.predict(docs, field, keep=["score"])
    assert kept.columns == ["doc_id", "lang_pred", "score", "score"]


def test_one_language_or_none(spark):
    docs = spark.createDataFrame([(1, "a b c", "xx"), (2, "d e f", None)], "doc_id bigint, text string, lang string")
    field = language.train(language.training_rows(docs, "true"))
    assert {r.lang_pred for r in language.predict(docs, field).collect()} == {"xx"}
    empty = language.train(language.training_rows(docs.limit(0), "true"))
    assert {(r.lang_pred, r.score) for r in language.predict(docs, empty).collect()} == {("und", 0.0)}


def test_words_of_switching_text(spark, field):
    text = "the of and that for with this der die und nicht von mit auf de la que los por una"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in language.label_words(docs, field).collect()}
    assert got[2] == [] and len(got[1]) == len(text.split())
    assert got[1][1] == "en" and got[1][9] == "de" and got[1][-2] == "es"
