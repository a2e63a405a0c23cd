"""Language of words and texts by a linear-chain conditional random field.

A word's features are the byte n-grams of the word between border marks, which take in its affixes,
and the word itself where the lexicon has it. Weights are learned together with the transitions
between the labels of neighbouring words, on sequences that switch language now and then. A text is
labelled word by word with forward-backward; its language is the one its words have most of.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import word_borders, word_hashes

UNKNOWN = "und"
#: Training rows of each language, and words of one row's sample: a fixed number of runs of words.
SAMPLE_ROWS, SAMPLE_RUNS, RUN_WORDS = 400, 4, 32
#: Hash buckets of n-gram weights; words of the lexicon per language; share of runs that switch.
BUCKETS, LEXICON, SWITCHED = 1 << 16, 300, 0.4
ORDERS = (2, 3, 4)
EPOCHS, RATE, DECAY = 6, 0.15, 1e-6
LETTER = regex.compile(r"\p{L}")
HAS_LETTER = r"\p{L}"  # the same for Spark


def word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts, word begins, word ends, words of each text)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    return data, *word_borders(data, np.array([len(p) for p in parts], np.int64))


def features(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashed: np.ndarray, lexicon: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of words with their hashes, how many each word has). Lexicon words come last."""
    size = end - begin + 2  # with a mark at both ends
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(begin)), size)
    place = np.arange(int(size.sum())) - first[owner]
    marked = np.zeros(len(owner), np.uint32)
    inner = (place > 0) & (place < size[owner] - 1)
    marked[inner] = data[begin[owner[inner]] + place[inner] - 1].astype(np.uint32) + 1
    numbers, owners = [], []
    gram = marked
    for n in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + marked[n - 1:] if len(gram) else gram
        if n in ORDERS:
            rows = np.flatnonzero(place[:len(gram)] + n <= size[owner[:len(gram)]])
            value = (gram[rows] + np.uint32(n)) * np.uint32(0x9E3779B1)
            numbers.append((value >> np.uint32(16)).astype(np.int64) % BUCKETS)
            owners.append(owner[rows])
    at = np.minimum(np.searchsorted(lexicon, hashed), max(len(lexicon) - 1, 0))
    known = np.flatnonzero(lexicon[at] == hashed) if len(lexicon) else np.empty(0, np.int64)
    numbers.append(BUCKETS + at[known])
    owners.append(known)
    number, own = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return number[order], np.bincount(own, minlength=len(begin))


@dataclass
class Field:
    """Learned weights: of features (rows) for labels (columns), transitions and starts."""

    labels: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def emissions(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of each word for each label; equal words are scored once."""
        if not len(begin) or not self.labels:
            return np.zeros((len(begin), len(self.labels)), np.float32)
        hashed, rows, inverse = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        out = np.empty((len(rows), len(self.labels)), np.float32)
        for at in range(0, len(rows), 20_000):
            own = rows[at:at + 20_000]
            number, count = features(data, begin[own], end[own], hashed[at:at + 20_000], self.lexicon)
            heads = np.cumsum(count) - count
            out[at:at + 20_000] = np.add.reduceat(self.weights[number], heads, axis=0)
        return out[inverse]

    def posteriors(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Forward-backward over many texts in step: label probabilities of each word."""
        return forward_backward(scores, counts, self.moves, self.starts)[0]


def forward_backward(scores, counts, moves, starts):
    """(posteriors, expected moves, expected starts) of sequences with ``counts`` words each.

    Sequences go in step, the longest first, so those still running are always the leading rows.
    """
    labels = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    likely = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step, start = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    forward = np.empty_like(likely)
    longest = int(sizes.max(initial=0))
    live = np.searchsorted(-sizes, -np.arange(longest), "left").tolist()  # sequences longer than t
    for t in range(longest):
        rows = first[:live[t]] + t
        now = likely[rows] * (start if t == 0 else forward[rows - 1] @ step)
        forward[rows] = now / now.sum(1, keepdims=True)
    back = np.ones((len(sizes), labels), likely.dtype)
    out = np.empty_like(likely)
    joint = np.zeros((labels, labels))
    for t in reversed(range(longest)):
        n = live[t]
        rows = first[:n] + t
        own = forward[rows] * back[:n]
        own /= own.sum(1, keepdims=True)
        out[rows] = own
        ahead = likely[rows] * back[:n]
        if t:
            both = forward[rows - 1][:, :, None] * step * ahead[:, None, :]
            joint += (both / both.sum((1, 2), keepdims=True)).sum(0)
        back[:n] = ahead @ step.T
        back[:n] /= back[:n].sum(1, keepdims=True)
    return out, joint, out[first[sizes > 0]].sum(0) if longest else np.zeros(labels)


def train(samples: list[tuple[str, str]], seed: int = 5) -> Field:
    """A field from (text, language) rows. Runs of words of one row keep its language."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in samples})
    texts = [t for t, _ in samples]
    data, begin, end, counts = word_arrays(texts)
    raw, offsets = data.tobytes(), np.cumsum(counts) - counts
    hashed = word_hashes(data, begin, end)
    frequent: dict[str, Counter] = {lang: Counter() for lang in labels}
    runs: dict[int, list[np.ndarray]] = {i: [] for i in range(len(labels))}
    for (_, lang), offset, count in zip(samples, offsets.tolist(), counts.tolist()):
        if not count:
            continue
        frequent[lang].update(raw[b:e] for b, e in zip(begin[offset:offset + count], end[offset:offset + count]))
        for at in rng.integers(0, max(1, count - RUN_WORDS + 1), SAMPLE_RUNS):
            runs[labels.index(lang)].append(offset + np.arange(at, min(count, at + RUN_WORDS)))
    words = sorted({w for c in frequent.values() for w, _ in c.most_common(LEXICON)})
    spelled = np.frombuffer(b"".join(words), np.uint8)
    stop = np.cumsum([len(w) for w in words], dtype=np.int64)
    lexicon = word_hashes(spelled, np.append(0, stop[:-1]), stop) if words else np.empty(0, np.uint64)
    lexicon = np.unique(lexicon)

    pool = [(k, r) for k, own in runs.items() for r in own]
    sequences, truth = [], []
    for k, r in pool:
        places, tags = [r], [np.full(len(r), k)]
        while len(pool) > 1 and rng.random() < SWITCHED and len(places) < 3:
            j, other = pool[rng.integers(len(pool))]
            piece = other[:max(1, int(rng.integers(len(other) + 1)))]
            places.append(piece)
            tags.append(np.full(len(piece), j))
        sequences.append(np.concatenate(places))
        truth.append(np.concatenate(tags))

    size = BUCKETS + len(lexicon)
    weights = np.zeros((size, len(labels)), np.float32)
    moves, starts = np.zeros((len(labels),) * 2), np.zeros(len(labels))
    grown = [np.full_like(x, 1e-6) for x in (weights, moves, starts)]
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(sequences))
        for at in range(0, len(shuffled), 128):
            picked = shuffled[at:at + 128]
            places, tags = np.concatenate([sequences[i] for i in picked]), np.concatenate([truth[i] for i in picked])
            lengths = np.array([len(sequences[i]) for i in picked])
            number, count = features(data, begin[places], end[places], hashed[places], lexicon)
            heads = np.cumsum(count) - count
            scores = np.add.reduceat(weights[number], heads, axis=0)
            belief, joint, first = forward_backward(scores, lengths, moves, starts)
            belief[np.arange(len(tags)), tags] -= 1
            heads = np.cumsum(lengths) - lengths
            inner = np.ones(len(tags), bool)
            inner[heads] = False
            after = np.flatnonzero(inner)
            np.subtract.at(joint, (tags[after - 1], tags[after]), 1)
            first = first - np.bincount(tags[heads], minlength=len(labels))
            owner = np.repeat(np.arange(len(places)), count)
            slope = np.stack(
                [np.bincount(number, belief[owner, k], size) for k in range(len(labels))], 1
            ).astype(np.float32)
            for value, change, seen in zip((weights, moves, starts), (slope, joint, first), grown):
                change = change / len(picked) + DECAY * value
                seen += change**2
                value -= RATE * change / np.sqrt(seen)
    return Field(labels, lexicon, weights, moves, starts)


def training_rows(
    documents: DataFrame, learns: Column | str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
) -> list[tuple[str, str]]:
    """(text, language) of the ``rows`` labelled rows of each language whose hashed id comes first."""
    known = documents.filter(learns).select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{text_col}`").alias("_text")
    ).filter("_lang IS NOT NULL AND _text IS NOT NULL")
    first = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = known.select("_id", "_lang").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows)
    texts = known.join(picked.drop("_n"), ["_id", "_lang"]).groupBy("_lang", "_id").agg(F.min("_text").alias("_text"))
    return sorted((r._text, r._lang) for r in texts.select("_text", "_lang").collect())


PREDICTED = "doc_id bigint, lang_pred string, score double"


def predict(
    documents: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", rows_a_batch: int = 2048,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, and the columns named in ``keep``.

    The language is the label that the words with a letter have most of, by mean probability, which
    is the score; ``und`` with score 0 if the text is null or has no letter. Ids may repeat or be
    null; an empty table gives no rows.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(field)  # BUCKETS rows of weights and the lexicon
    others = keep or []
    kept = ", ".join(f"`_{i}` {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(others))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(at, rows_a_batch)
                texts = [t if t and LETTER.search(t) else "" for t in part.column(1).to_pylist()]
                shares = text_shares(own, texts)
                best = shares.argmax(1)
                empty = shares.sum(1) == 0
                names = [UNKNOWN if e else own.labels[b] for e, b in zip(empty.tolist(), best.tolist())]
                score = np.where(empty, 0.0, shares[np.arange(len(best)), best])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), *part.columns[2:]],
                    names=["doc_id", "lang_pred", "score", *(f"_{i}" for i in range(len(others)))],
                )

    narrow = documents.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)],
    )
    out = narrow.mapInArrow(run, PREDICTED + (", " + kept if kept else ""))
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)])


def text_shares(field: Field, texts: list[str]) -> np.ndarray:
    """(texts, labels): mean label probabilities of each text's words with a letter; 0 without any."""
    if not field.labels:
        return np.zeros((len(texts), 1))
    data, begin, end, counts = word_arrays(texts)
    belief = field.posteriors(field.emissions(data, begin, end), counts)
    # a word has a letter if it has an ASCII letter or any other character; others count if alone
    lettered = np.append(0, np.cumsum((data >= 0x80) | ((data >= 97) & (data <= 122))))
    lettered = (lettered[end] > lettered[begin]).astype(np.float64)
    out = np.zeros((len(texts), len(field.labels)))
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.bincount(owner, lettered, len(texts))
    weight = np.where(total[owner] > 0, lettered, 1.0)
    total = np.bincount(owner, weight, len(texts))
    for k in range(len(field.labels)):
        out[:, k] = np.bincount(owner, belief[:, k] * weight, len(texts)) / np.maximum(total, 1)
    return out


def label_words(
    documents: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", rows_a_batch: int = 512
) -> DataFrame:
    """doc_id and the most likely label of each word, in order: doc_id, labels array<string>."""
    shipped = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(at, rows_a_batch)
                data, begin, end, counts = word_arrays([t or "" for t in part.column(1).to_pylist()])
                best = own.posteriors(own.emissions(data, begin, end), counts).argmax(1)
                names = pa.array([own.labels[b] for b in best.tolist()], pa.string())
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, names)], names=["doc_id", "labels"]
                )

    narrow = documents.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id bigint, labels array<string>")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text null."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % folds


def fit_and_predict(documents: DataFrame, *, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """Train on rows outside the held-out fold and label all: doc_id, held_out, lang_pred, score."""
    held = fold("doc_id", folds) == held_fold
    field = train(training_rows(documents, ~held))
    return predict(documents, field).select("doc_id", held.alias("held_out"), "lang_pred", "score")
