import hashlib
import random
import re

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from tallyshelf.llm import language, mixing
from tallyshelf.llm.registry import piece_model

from test_jaccard import brute as groups
from test_suffix_dedup import brute as repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(9)
    words = {"en": "the of and that is for with this was are".split(), "de": "der die und nicht von mit auf das ist ein".split()}
    passage = " ".join(rng.choices(words["en"], k=60))
    rows = []
    for i in range(80):
        lang = rng.choice(["en", "de"])
        own = [rng.choice(words[lang]) + rng.choice(["", "a", "b", "c"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(8, 70))]
        text = " ".join(own) + (". " + passage if rng.random() < 0.2 else "")
        rows.append((i, text, None if rng.random() < 0.1 else lang, rng.choice(["s1", "s2", "s2", "s2", None]), len(text)))
    for i in range(80, 100):
        _, text, lang, source, n = rows[i - 60]
        rows.append((i, text + (" " + lang if lang and i % 2 else ""), lang, source, n))
    return rows + [(100, None, "en", "s1", None), (101, "", None, "s3", 0), (102, "1 2 | 3", "en", "s2", 7)]


def plain(rows, samples):
    field = language.train(samples)
    told = [field.labels[s.argmax()] if s.sum() else "und" for s in language.text_shares(
        field, [t if t and language.LETTER.search(t) else "" for _, t, *_ in rows])]
    kept = [(i, t, la or p, so, n) for (i, t, la, so, n), p in zip(rows, told) if p != "und"]
    lead = {i for i, _, root in groups([(r[0], r[1]) for r in kept]) if i == root}
    kept = [r for r in kept if r[0] in lead]
    flags = repeats([(r[0], r[1]) for r in kept], 100)
    cut = []
    for k, r in enumerate(kept):
        data = bytes(b for b, gone in zip(r[1].encode(), flags[k]) if not gone).decode("utf-8", "ignore")
        cut.append((r[0], data, r[2], r[3], len(data)))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", cut)
    taken = {d: (t, s) for d, s, t in connection.execute(f"SELECT doc_id, size, taken FROM ({mixing.SQL})").fetchall()}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = []
    for r in cut:
        words, size = taken[r[0]]
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        ids = library.encode(r[1], add_eos=True)
        row = (r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids)
        out += [row] * (words // size if size else 0)
    return sorted(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_against_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got)
    full = [r for r in plain(corpus(), language.training_rows(docs, "true"))]
    sized = {r[0] for r in full}
    assert [r for r in rows if r[0] in sized] == full


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for rows in (docs, docs.limit(0)):
            assert stage(spark, rows, folder).dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_texts_without_any_label_are_kept(spark, folder):
    docs = spark.createDataFrame([(i, t, None, so, n) for i, t, _, so, n in corpus()], SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in kept) == list(range(100)) and {r.lang for r in kept} == {None}
    odd = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["½ 2", "_ 3", "ß", "語", "٣", "Ⅷ 3²", "ʰ"])], SCHEMA)
    # by Unicode category: numbers of any kind are no letters, modifier letters are
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, odd, folder).collect()) == [2, 3, 6]


def test_nothing_but_the_plain_rows_comes_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got)
    # a text without words has its end id only; the plain version leaves those out
    assert [r for r in rows if r[1] > 1] == plain(corpus(), language.training_rows(docs, "true"))
    assert not {100, 101, 102} & {r[0] for r in rows}
