"""Queries that apply the operators to the given tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, centroids, deleted, embedding_dedup, jaccard, language, mixing, neighbours, pieces, substring_dedup,
    suffix_dedup, toxicity, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every text that repeat an earlier 100-byte passage, and what is kept."""
    return suffix_dedup.repeat_digests(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every text that 13-word passages of earlier documents cover, and what is kept."""
    return substring_dedup.repeat_digests(table(spark, folder, "documents"))


def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with the number of near-duplicates under its label and the component they make."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every text under the interpolated model, and under the add-one baseline."""
    return deleted.scored(table(spark, folder, "documents"))


def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found for each vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, folder, "embeddings"), "vec_id % 100 = 0")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded with an end id and decoded again, as digests."""
    return pieces.encode_digests(table(spark, folder, "documents"), piece_model())


def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of shingles and the group of near-duplicates it is in."""
    return jaccard.similar_rows(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned from four fifths of the labelled documents."""
    return toxicity.fit_and_predict(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned from two thirds of the documents' labels."""
    return language.fit_and_predict(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    return mixing.mix_table(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its cluster and distance after five rounds, in whole numbers."""
    return centroids.clustered(table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first 32 principal components, scaled to variance one, in long form."""
    return whitening.whitened(table(spark, folder, "embeddings"))


def byte_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to byte-level tokens and decoded again, as digests."""
    return byte_bpe.encode_digests(table(spark, folder, "documents"), byte_model())


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
        "op11_centroids": op11_centroids,
        "op12_whitening": op12_whitening,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.SQL,
        "op2_substring_dedup": substring_dedup.SQL,
        "op3_embedding_dedup": embedding_dedup.SQL,
        "op7_ngram_jaccard": jaccard.SQL,
        "op10_mixing": mixing.SQL,
        "op11_centroids": centroids.SQL,
    }
