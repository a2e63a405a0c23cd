"""From raw documents to token ids: five stages, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.llm import jaccard, language, mixing, pieces, suffix_dedup
from tallyshelf.llm.registry import piece_model, table
from tallyshelf.sources.tables import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing label is filled in if any could be learned.

    Null texts and texts without a letter go, whether or not a label could be learned. Repeated rows and
    ids stay, an empty table gives an empty one, and further columns of any name come along.
    """
    field = language.train(language.training_rows(docs, "true"))
    given = [f"column {i}" for i in range(len(docs.columns))]  # no name of the input meets a name used here
    told = language.predict(docs, field, keep=docs.columns).toDF("told id", "told", "told score", *given)
    of = dict(zip(docs.columns, map(F.col, given)))
    told = told.filter(of["text"].rlike(language.HAS_LETTER))
    known = F.when(F.col("told") != language.UNKNOWN, F.col("told"))
    of["lang"] = F.coalesce(of["lang"], known)
    return told.select(*[column.alias(name) for name, column in of.items()])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.without_similar(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or their own text before, has."""
    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    return pieces.encode_digests(docs, piece_model(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot state the first and the last stage; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
