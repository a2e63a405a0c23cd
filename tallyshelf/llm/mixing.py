"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the documents are put in key order, cut into
key ranges; sums per range give the running word count at which each range starts, and a window
inside the range does the rest, so a source with a third of all documents is spread over as many
tasks as it has ranges. The order is repeated (epochs) and cut where the source's budget ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Key ranges a source is cut into: 16 to the power of the hex digits.
RANGE_DIGITS = 3
SALT = "mix"


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(_source, source_size, target) from (_source, _size) rows; one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share all words by weight.
    A target ends at ``max_epochs`` times the source; the excess goes to the others by weight. With
    sources in order of (limit / weight), those at their limit come first: a source is one of them
    if its limit is not above its share of what the sources before it leave.
    """
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    turn = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")
    )
    limit = F.col("source_size") * max_epochs
    ranked = totals.withColumn("_weight", weight.cast("double")).withColumn("_limit", limit.cast("double"))
    order = Window.orderBy(
        F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last()
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    level = ranked.withColumn("_level", left / F.sum("_weight").over(onwards))
    free = F.min(F.when(F.col("_limit") > F.col("_level") * F.col("_weight"), F.col("_limit") / F.col("_weight")))
    # the level of the first source below its limit holds for all that follow
    first = level.withColumn("_first", free.over(everyone)).withColumn(
        "_share",
        F.max(F.when(F.col("_limit") / F.col("_weight") == F.col("_first"), F.col("_level"))).over(everyone),
    )
    target = F.when(
        F.col("_first").isNotNull() & (F.col("_limit") / F.col("_weight") >= F.col("_first")),
        F.least(F.col("_share") * F.col("_weight"), F.col("_limit")),
    ).otherwise(F.col("_limit"))
    return first.select("_source", "source_size", target.alias("target"))


def mix_table(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, salt: str = SALT,
) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, times, taken.

    One row per input row. Size is the number of words (null text: 0). ``times`` counts the epochs
    that take the document; ``taken`` is ``times * size``. Documents are taken whole: a source is cut
    at the document border nearest its target. Null ids and null sources are values like any other;
    rows that share an id are ordered by size and source and counted each. A source without words has target 0 and
    gives no documents; an empty table gives no rows. Same rows, same salt: same result, however
    they are partitioned. Other columns of the input, whatever their names, are not read.
    """
    key = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sizes = cut_lineage(
        documents.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
            word_count(text_col).alias("_size"), key.alias("_key"),
        ),
        "mix",
    )
    ranged = sizes.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    per_range = ranged.groupBy("_source", "_range").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        F.col("_source").alias("_s"), F.col("_range").alias("_r"),
        F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"),
    )
    targets = source_targets(sizes, weights, max_epochs).withColumnRenamed("_source", "_t")
    starts = starts.join(targets, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    within = Window.partitionBy("_source", "_range").orderBy("_key", "_id", "_size")
    before = F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(
        starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))
    ).withColumn("_before", F.col("_start") + before - F.col("_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    reached = (F.col("source_size") > 0) & (F.col("_before") + F.col("_size") / 2 <= rest) & (rest > 0)
    return placed.withColumn("times", (epochs + F.when(reached, 1).otherwise(0)).cast("int")).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
        "source_size", "target", "times", (F.col("times") * F.col("_size")).cast("long").alias("taken"),
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it; columns as given.

    Rows that share an id and a source are taken as often as the least taken of them. The columns come
    along as one struct, so that none of them, whatever its name, meets a name used here. Nulls, empty
    and very long texts, repeated rows and empty tables are treated as by ``mix_table``.
    """
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    times = mix_table(documents, **options).groupBy("doc_id", "source").agg(F.min("times").alias("_times"))
    times = times.filter(F.col("_times") > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), "_times"
    )
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    own_id, own_source = F.col("_row").getField(id_col), F.col("_row").getField(source_col)
    joined = rows.join(times, own_id.eqNullSafe(F.col("_id")) & own_source.eqNullSafe(F.col("_src")))
    repeated = joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_epoch"))
    return repeated.select(*[F.col("_row").getField(c).alias(c) for c in documents.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), limits AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS most, CAST(3 * source_size AS DOUBLE) / weight AS ratio
  FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (
              ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (
              ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM limits
), firsts AS (
  SELECT *, min(CASE WHEN most > level * weight THEN ratio END) OVER () AS first FROM levels
), shares AS (
  SELECT *, max(CASE WHEN ratio = first THEN level END) OVER () AS share FROM firsts
), targets AS (
  SELECT source, source_size,
         CASE WHEN first IS NOT NULL AND ratio >= first THEN least(share * weight, most) ELSE most END AS target
  FROM shares
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN source_size > 0 AND before + size / 2 <= target - epochs * source_size
         AND target - epochs * source_size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
