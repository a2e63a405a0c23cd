"""Language-model scores by deleted interpolation of n-gram estimates.

Training documents are parted: a seventh is set aside ("deleted"), the others give counts. How far an
estimate of each order can be trusted depends on how often its context was seen, so contexts fall in
buckets by the logarithm of their count, and each bucket mixes the orders, down to the uniform
distribution, with weights of its own. Expectation-maximisation finds the weights that make the
deleted documents likeliest. Scores then use the counts of all training documents.

Chunks of documents send their distinct n-grams with counts to buckets of the n-gram's hash, which
add up and answer each chunk with the counts of what it asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from .anchors import mixed
from .chunks import (
    MESSAGE, bucket_of, buckets_for, chunk_bytes_of, cuts, each_chunk, messages, pack, per_chunk, rows_table, unpack,
    write_chunks,
)
from .language import fold
from .words import LOWER, word_borders, word_hashes

ORDER, FOLDS, HELD_FOLD, DELETED_FOLD = 2, 7, 2, 3
#: Hashes that stand for the end of a text and for what is before its first word.
END, START = np.uint64(0xE14D0F7E87), np.uint64(0x57A127B16)
#: Estimates of deleted events are grouped by logarithm in steps of a quarter octave.
STEPS, CONTEXTS, ROUNDS = 4, 32, 60
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, tokens of each text): lower-cased words, then one end."""
    data, sizes = chunk_bytes_of(chunk)
    data = LOWER[data]
    begin, end, counts = word_borders(data, sizes)
    out = np.full(len(begin) + len(sizes), END, np.uint64)
    owner = np.repeat(np.arange(len(sizes)), counts)
    out[np.arange(len(begin)) + owner] = word_hashes(data, begin, end)
    return out, counts + 1


def gram_keys(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for orders 1 to ``order``."""
    heads = np.cumsum(lengths) - lengths
    place = np.arange(len(tokens)) - np.repeat(heads, lengths)
    keys = []
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            value = np.zeros(len(tokens), np.uint64) + np.uint64(n)
            for back in range(n - 1, -1, -1):
                own = np.full(len(tokens), START, np.uint64)
                inside = np.flatnonzero(place >= back)
                own[inside] = tokens[inside - back]
                value = mixed(value * ODD + own)
            keys.append(value)
    return keys


def folds_of(ids: list, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(("null" if i is None else str(i)).encode()) % folds for i in ids], np.int64)


class Parts:
    """Which fold of the ids is never learned from, and which is deleted in training."""

    def __init__(self, folds: int, held: int, deleted: int):
        self.folds, self.held, self.deleted = folds, held, deleted

    def weights(self, ids: list) -> tuple[np.ndarray, np.ndarray]:
        """For each text: 1 if in training, 1 if also not deleted."""
        fold_of = folds_of(ids, self.folds)
        learned = fold_of != self.held
        return learned.astype(np.int64), (learned & (fold_of != self.deleted)).astype(np.int64)


def _distinct(chunk: dict, order: int, parts: Parts):
    """Per order: sorted distinct keys, their counts in training and in its undeleted part."""
    tokens, lengths = tokens_of(chunk)
    learned, kept = parts.weights(chunk["ids"])
    learned, kept = np.repeat(learned, lengths), np.repeat(kept, lengths)
    for key in gram_keys(tokens, lengths, order):
        names, inverse = np.unique(key, return_inverse=True)
        yield names, inverse, (
            np.bincount(inverse, learned, len(names)).astype(np.uint32),
            np.bincount(inverse, kept, len(names)).astype(np.uint32),
        )


def _short(names: np.ndarray) -> bytes:
    """Six bytes a key: with the bucket they come to 48 bits and the bucket's."""
    return names.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


ANSWER = "chunk bigint, payload binary, tokens bigint, words bigint, kept_tokens bigint, kept_words bigint"


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of a bucket's keys over all chunks, sent back to each, and the sums over single tokens."""
    sent = [unpack(b) for b in table.column("payload").to_pylist()]
    bucket = table.column("bucket")[0].as_py()
    answers: list[list[np.ndarray]] = [[] for _ in sent]
    sums = [0, 0, 0, 0]
    for n in range(len(sent[0]) // 3):
        keys = [_long(s[3 * n]) for s in sent]
        names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [
            np.bincount(inverse, np.concatenate([s[3 * n + k] for s in sent]), len(names)).astype(np.int64) for k in (1, 2)
        ]
        if n == 0:
            sums = [int(c) for x in counts for c in (x.sum(), (x > 0).sum())]
        edge = np.cumsum([0, *map(len, keys)])
        for answer, lo, hi in zip(answers, edge[:-1].tolist(), edge[1:].tolist()):
            answer += [c[inverse[lo:hi]].astype(np.uint32) for c in counts]
    rows = [
        (chunk, pack(bucket, *answer), 0, 0, 0, 0)
        for chunk, answer in zip(table.column("chunk").to_pylist(), answers)
    ]
    return rows_table([*rows, (None, None, *sums)], ANSWER)


def _answers(names: list[np.ndarray], count: int, sent: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order: counts in training and in its undeleted part of the chunk's sorted distinct keys."""
    out = [(np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)) for n in names]
    slices = [dict(cuts(bucket_of(n, count))) for n in names]
    for bucket, *answer in map(unpack, sent):
        for n, (learned, kept) in enumerate(out):
            if bucket in slices[n]:
                learned[slices[n][bucket]], kept[slices[n][bucket]] = answer[2 * n], answer[2 * n + 1]
    return out


def estimates(counts: list[np.ndarray], lengths: np.ndarray, tokens: int, words: int, texts: int):
    """(bucket, [estimate of each order from 0 up]) of every token.

    ``counts`` are those of the n-grams that end at each token, by order; order 0 is the uniform
    distribution over the known words and one unknown. An estimate whose context was never seen is 0.
    The bucket is the longest context seen and the logarithm of its count.
    """
    heads = np.cumsum(lengths) - lengths
    out = [np.full(len(counts[0]), 1.0 / (words + 1)), counts[0] / max(tokens, 1)]
    bucket = np.zeros(len(counts[0]), np.int64)
    for n in range(2, len(counts) + 1):
        context = np.empty(len(counts[0]), np.int64)
        context[1:] = counts[n - 2][:-1]
        context[heads] = texts
        seen = context > 0
        out.append(np.where(seen, counts[n - 1] / np.maximum(context, 1), 0.0))
        level = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), CONTEXTS - 1)
        bucket = np.where(seen, (n - 1) * CONTEXTS + level, bucket)
    return bucket, out


def grouped_events(bucket: np.ndarray, estimate: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(event as a number, how often): bucket and rounded logarithms of the estimates over the uniform one."""
    code = bucket.copy()
    for p in estimate[1:]:
        ratio = np.zeros(len(p), np.int64)
        some = p > 0
        ratio[some] = np.clip(np.rint(STEPS * np.log2(p[some] / estimate[0][some])) + 64, 1, 255)
        code = code * 256 + ratio
    return np.unique(code, return_counts=True)


def mixture_weights(events: list[tuple[int, int]], order: int) -> np.ndarray:
    """(buckets, order + 1) weights by expectation-maximisation; a row adds up to 1.

    A bucket without events takes the weights of the nearest bucket that has some.
    """
    size = CONTEXTS * max(order, 1)
    weights = np.zeros((size, order + 1))
    if events:
        code, times = (np.array(x) for x in zip(*events))
        ratio = [np.ones(len(code))]
        rest = code.copy()
        for _ in range(order):
            q = rest % 256
            ratio.insert(1, np.where(q > 0, 2.0 ** ((q - 64) / STEPS), 0.0))
            rest //= 256
        ratio = np.stack(ratio, 1)
        for b in np.unique(rest):
            own = rest == b
            p, n = ratio[own], times[own]
            usable = np.arange(order + 1) <= max(1, b // CONTEXTS + 1)
            w = usable / usable.sum()
            for _ in range(ROUNDS):
                share = p * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[:, None]).sum(0) + 1e-3 * usable  # no order is ever shut out
                w /= w.sum()
            weights[b] = w
    known = np.flatnonzero(weights.sum(1))
    for b in range(size):
        usable = np.arange(order + 1) <= max(1, b // CONTEXTS + 1)
        if not weights[b].any():
            own = weights[known[np.abs(known - b).argmin()]] * usable if len(known) else usable.astype(float)
            weights[b] = own / own.sum()
    return weights


SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def scored(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = FOLDS,
    held_fold: int = HELD_FOLD, deleted_fold: int = DELETED_FOLD, chunk_bytes: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z in lower case, and one end. Rows whose crc32 of the id as
    text, modulo ``folds``, is ``held_fold`` are scored only; of the others, ``deleted_fold`` fits
    the weights. ``base_score`` is the add-one unigram log10 probability, ``score`` the model's.
    Null texts count as empty and have the end alone; a null id counts as the text null. Rows that
    share an id count each. Without training rows every token is unknown. An empty table gives no rows.
    """
    parts = Parts(folds, held_fold, deleted_fold)
    narrow = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    deleted = fold("doc_id", folds) == deleted_fold
    options = {} if chunk_bytes is None else {"chunk_bytes": chunk_bytes}
    most = write_chunks(narrow.filter(~deleted), **options).drop("rest")
    few = write_chunks(narrow.filter(deleted), **options).drop("rest").withColumn("chunk", -F.col("chunk") - 1)
    chunks = most.unionByName(few)
    count = buckets_for(chunks)
    texts = narrow.select("doc_id").groupBy(fold("doc_id", folds).alias("fold")).count().collect()  # ``folds`` rows
    all_texts = sum(r["count"] for r in texts if r.fold != held_fold)
    kept_texts = all_texts - sum(r["count"] for r in texts if r.fold == deleted_fold and r.fold != held_fold)

    def ask(chunk: dict) -> pa.Table:
        letters: dict[int, list] = {}
        for n, (names, _, counts) in enumerate(_distinct(chunk, order, parts)):
            for b, s in cuts(bucket_of(names, count)):
                own = letters.setdefault(b, [b"", *[np.empty(0, np.uint32)] * 2] * order)
                own[3 * n:3 * n + 3] = [_short(names[s]), counts[0][s], counts[1][s]]
        return messages([(b, chunk["chunk"], pack(*own)) for b, own in letters.items()])

    answers = cut_lineage(
        each_chunk(chunks, ask, MESSAGE).groupBy("bucket").applyInArrow(_add_up, ANSWER), "counts"
    )
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words", "kept_tokens", "kept_words")]).first()
    tokens, words, kept_tokens, kept_words = sums
    letters = answers.filter("chunk IS NOT NULL").select("chunk", "payload")

    def counted(chunk: dict, sent: list[bytes]):
        names, inverses = [], []
        stream, lengths = tokens_of(chunk)
        for key in gram_keys(stream, lengths, order):
            name, inverse = np.unique(key, return_inverse=True)
            names.append(name)
            inverses.append(inverse)
        found = _answers(names, count, sent)
        return lengths, [f[0][i] for f, i in zip(found, inverses)], [f[1][i] for f, i in zip(found, inverses)]

    def group(chunk: dict, sent: list[bytes]) -> pa.Table:
        lengths, _, kept = counted(chunk, sent)
        code, times = grouped_events(*estimates(kept, lengths, kept_tokens, kept_words, kept_texts))
        return pa.table({"event": pa.array(code, pa.int64()), "times": pa.array(times, pa.int64())})

    events = []
    if deleted_fold != held_fold:
        grouped = per_chunk(few, letters.filter("chunk < 0"), group, "event bigint, times bigint")
        # as many events at most as there are buckets times grid points, whatever the corpus
        events = [(r.event, r.times) for r in grouped.groupBy("event").agg(F.sum("times").alias("times")).collect()]
    weights = mixture_weights(events, order)

    def score(chunk: dict, sent: list[bytes]) -> pa.Table:
        lengths, learned, _ = counted(chunk, sent)
        bucket, estimate = estimates(learned, lengths, tokens, words, all_texts)
        own = weights[bucket]
        chance = sum(own[:, k] * p for k, p in enumerate(estimate))
        heads = np.cumsum(lengths) - lengths
        base = np.log10((learned[0] + 1) / (tokens + 1 * (words + 1)))
        sums = [np.add.reduceat(x, heads) for x in (base, np.log10(chance), (learned[0] > 0).astype(np.int64))]
        return pa.table({
            "doc_id": pa.array(chunk["ids"], pa.int64()),
            "held_out": pa.array(folds_of(chunk["ids"], folds) == held_fold),
            "n_tokens": pa.array(lengths), "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(len(lengths), tokens)),
            "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
        })

    return per_chunk(chunks, letters, score, SCORES)
