"""Columns that come along: not nullable, nested, of any name."""

from pyspark.sql import functions as F

from tallyshelf.llm import jaccard, suffix_dedup

TEXT = " ".join(f"word{i}" for i in range(40))


def test_columns_that_cannot_be_null_are_carried(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "other words here")], "doc_id bigint, text string")
    docs = docs.withColumn("x", F.lit("z")).withColumn("n", F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")))
    docs = docs.withColumn("_text", F.lit(5)).withColumn("rest", F.create_map(F.lit("k"), F.lit(1.5)))
    assert not docs.schema["x"].nullable
    for kept in (jaccard.without_similar(docs), suffix_dedup.without_repeats(docs)):
        rows = kept.collect()
        assert kept.columns == docs.columns and {r.doc_id for r in rows} >= {1, 3}
        assert {(r.x, r.n.a, tuple(r.n.b), r._text, r.rest["k"]) for r in rows} == {("z", 1, (2,), 5, 1.5)}


def test_every_stage_takes_columns_of_any_name(spark):
    import corpus_pipeline

    names = ["_id", "_lang", "_score", "_n", "_text", "_rest", "_src", "_times", "_epoch", "_row", "told", "rest", "ids", "score", "_0"]
    docs = spark.createDataFrame(
        [(i, f"{TEXT} and some more words {i} of the text {i}", "en" if i % 2 else None, "ab"[i % 3 == 0], 100) for i in range(12)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))  # not nullable either
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        rows = out.collect()
        assert rows, name
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
            assert {r[n] for r in rows for n in names} == {"own"}, name
