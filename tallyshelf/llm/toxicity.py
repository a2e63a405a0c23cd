"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

Two words are alike by the letters they share in order, gaps allowed: each triple of bytes, in order
and within ``SPAN``, counts ``DECAY`` to the power of its length. Characters put into a word or left
out cost some triples, not all. A text meets a landmark in its most alike word. The similarities to
all landmarks, mapped by the inverse root of the landmarks' own kernel matrix, are what a linear
machine is trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import fold, word_arrays
from .words import word_hashes

#: Longest triple, weight of a symbol it spans, and the power the likeness is taken to.
SPAN, DECAY, POWER = 5, 0.7, 3
#: Words a Python worker remembers with their likeness to every landmark.
MEMO = 200_000
#: Longer words are cut into pieces that overlap by half.
PIECE = 32
#: Landmarks, and those taken even if none is significant; bytes of a stem; standard errors between the
#: shares of texts that the classes have a landmark in; how much of the difference a longer stem has to keep.
LANDMARKS, LEAST, STEM, ERRORS, KEPT_SHARE = 64, 16, (4, 8), 2.5, 0.9
#: Training rows of each class; passes and strength of regularisation of the machine.
SAMPLE_ROWS, STEPS, REGULAR = 1500, 800, 1e-4
#: Characters put into the landmarks of toxic training rows, for copies that hold them disguised.
MASKS = "-.*_"
FRONT, BACK = 1, 2  # marks around a word
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


def trimmed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word borders without ASCII punctuation at the ends, long words in pieces; empty ones vanish."""
    plain = (data >= 0x80) | ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122))
    place = np.arange(len(data) + 1)
    after = np.minimum.accumulate(np.where(np.append(plain, True), place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(np.append(True, plain), place, 0))
    begin, end = np.minimum(after[begin], end), before[end]
    return begin, np.maximum(begin, end)


def pieces(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, word) of the pieces of at most ``PIECE`` bytes."""
    half = PIECE // 2
    size = end - begin
    count = np.where(size <= PIECE, np.minimum(size, 1), -(-(size - PIECE) // half) + 1)
    word = np.repeat(np.arange(len(begin)), count)
    step = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    first = begin[word] + step * half
    return first, np.minimum(first + PIECE, end[word]), word


def triples(
    data: np.ndarray, begin: np.ndarray, end: np.ndarray, stem: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, triple of bytes as a number, weight) of all words, gap pattern by gap pattern."""
    size = end - begin + (1 if stem else 2)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(begin)), size)
    place = np.arange(len(owner)) - first[owner]
    marked = np.full(len(owner), FRONT, np.int64)
    inner = (place > 0) & (place <= (end - begin)[owner])
    marked[inner] = data[begin[owner[inner]] + place[inner] - 1]
    marked[place > (end - begin)[owner]] = BACK
    left = size[owner] - place  # symbols from here to the end of the word
    for a, b in GAPS:
        rows = np.flatnonzero(left > a + b)
        code = (marked[rows] << 16) | (marked[rows + a] << 8) | marked[rows + a + b]
        yield owner[rows], code, DECAY ** (a + b + 1)


def sizes(length: np.ndarray) -> np.ndarray:
    """Norm of words by their number of symbols, marks included."""
    total = np.zeros(len(length))
    for a, b in GAPS:
        total += np.maximum(length - a - b, 0) * DECAY ** (2 * (a + b + 1))
    return np.sqrt(total)


@dataclass
class Machine:
    """Landmark words, the triples they hold, and the trained weights."""

    names: list[bytes]
    rows: np.ndarray  # triple number -> row of ``table``, -1 if no landmark has it
    table: np.ndarray  # weight of each triple in each landmark, over the landmark's norm
    root: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memo"}

    def word_likeness(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``likeness`` of distinct words with their hashes; those met first are remembered.

        The memo lives as long as the machine, in a Python worker from task to task. It takes ``MEMO``
        words at most; frequent words are met early, so it is not emptied.
        """
        known, place, rows = self.__dict__.setdefault(
            "memo", (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, len(self.names)), np.float32))
        )
        at = np.searchsorted(known, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(known)
        hit[inside] = known[at[inside]] == keys[inside]
        out = np.zeros((len(keys), len(self.names)), np.float32)
        out[hit] = rows[place[at[hit]]]
        new = np.flatnonzero(~hit)
        part = self.likeness(data, begin[new], end[new])
        out[new[:len(part)]] = part
        added = new[:MEMO - len(known)]
        if len(added):
            place = np.insert(place, at[added], len(rows) + np.arange(len(added)))
            self.memo = np.insert(known, at[added], keys[added]), place, np.concatenate([rows, out[added]])
        return out

    def likeness(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(words, landmarks): the kernel of each word with each landmark."""
        begin, end, word = pieces(begin, end)
        total = int(word.max(initial=-1)) + 1
        out = np.zeros((total, len(self.names)), np.float32)
        for at in range(0, len(begin), 8192):
            b, e = begin[at:at + 8192], end[at:at + 8192]
            found = [(o, self.rows[c], w) for o, c, w in triples(data, b, e)]
            owner = np.concatenate([o[r >= 0] for o, r, _ in found])
            value = np.concatenate([self.table[r[r >= 0]] * np.float32(w) for _, r, w in found])
            order = np.argsort(owner, kind="stable")
            heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
            if len(heads):
                own = owner[order][heads]
                sums = np.add.reduceat(value[order], heads, axis=0)
                sums /= sizes((e - b)[own] + 2)[:, None]
                np.maximum.at(out, word[at + own], sums.astype(np.float32) ** POWER)
        return out

    def text_likeness(self, texts: list[str]) -> np.ndarray:
        """(texts, landmarks): the kernel of the most alike word of each text; 0 without words."""
        data, begin, end, counts = word_arrays(texts)
        begin, end = trimmed(data, begin, end)
        out = np.zeros((len(texts), len(self.names)), np.float32)
        if not len(begin) or not self.names:
            return out
        # the hash needs words in order; empty ones stay in place
        keys, rows, inverse = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        known = self.word_likeness(keys, data, begin[rows], end[rows])
        heads = np.cumsum(counts) - counts
        full = counts > 0
        for at in range(0, len(self.names), 16):  # a few landmarks at a time, for memory
            out[full, at:at + 16] = np.maximum.reduceat(known[inverse, at:at + 16], heads[full], axis=0)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = (self.text_likeness(texts) @ self.root) @ self.weights + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin + self.shift)))


def _landmarks(texts: list[str], toxic: np.ndarray) -> list[bytes]:
    """Words and stems that far more toxic texts have than others; of a stem's words only one."""
    seen = [Counter(), Counter()]
    for text, label in zip(texts, toxic.tolist()):
        data, begin, end, _ = word_arrays([text])
        begin, end = trimmed(data, begin, end)
        raw = data.tobytes()
        own = {raw[b:e] for b, e in zip(begin.tolist(), end.tolist()) if e > b}
        own |= {w[:n] + b"*" for w in own for n in range(STEM[0], STEM[1]) if len(w) > n}
        seen[label].update(own)
    totals = np.maximum(np.bincount(toxic, minlength=2), 1)
    contrast = {w: seen[1][w] / totals[1] - seen[0][w] / totals[0] for w in seen[0] | seen[1]}
    error = {}  # of the difference if both classes had the word equally often
    for w in contrast:
        share = (seen[0][w] + seen[1][w]) / totals.sum()
        error[w] = np.sqrt(share * (1 - share) * (1 / totals).sum())
    by_stem: dict[bytes, list[bytes]] = {}
    for w in contrast:
        by_stem.setdefault(w[:STEM[0]], []).append(w)

    def longest(w: bytes) -> bytes:
        """The longest word or stem that goes on from ``w`` and tells nearly as much."""
        stem = w.rstrip(b"*")
        if len(stem) < STEM[0]:
            return w
        alike = [
            v for v in by_stem[w[:STEM[0]]]
            if v.startswith(stem) and abs(contrast[v]) >= KEPT_SHARE * abs(contrast[w]) and contrast[v] * contrast[w] > 0
        ]
        return max([w, *alike], key=lambda v: (len(v.rstrip(b"*")), not v.endswith(b"*"), v))

    def same(w: bytes, v: bytes) -> bool:
        """A longer or shorter stem says the same; words too short for a stem only stand for themselves."""
        w, v = sorted((w.rstrip(b"*"), v.rstrip(b"*")), key=len)
        return w == v or len(w) >= STEM[0] and v.startswith(w)

    chosen: list[bytes] = []
    rank = {w: contrast[w] / max(error[w], 1e-9) for w in contrast if contrast[w] > 0}
    for w in sorted(rank, key=lambda w: (-rank[w], w)):
        if len(chosen) >= LANDMARKS or rank[w] < ERRORS and len(chosen) >= LEAST:
            break
        w = longest(w)
        if not any(same(w, c) for c in chosen):
            chosen.append(w)
    return chosen


def _disguised(texts: list[str], names: list[bytes]) -> list[str]:
    """The texts that hold a landmark, with a character put into each word that is one or begins as one."""
    stems = [re.escape(n.rstrip(b"*").decode("utf-8", "ignore")) + (r"\w*" if n.endswith(b"*") else "") for n in names]
    stems = [s for n, s in zip(names, stems) if len(n.rstrip(b"*")) >= STEM[0]]
    known = re.compile(rf"(?<!\w)(?:{'|'.join(stems)})(?!\w)", re.IGNORECASE) if stems else None
    out = []
    for turn, text in enumerate(texts):
        def put(found: re.Match) -> str:
            word = found.group()
            at = 1 + turn % max(len(word) - 1, 1)
            return word[:at] + MASKS[turn % len(MASKS)] + word[at:]

        changed = known.sub(put, text) if known else text
        if changed != text:
            out.append(changed)
    return out


def _landmark_triples(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.full(1 << 24, -1, np.int16)
    found: dict[int, int] = {}
    cells: list[tuple[int, int, float]] = []
    for i, name in enumerate(names):
        stem = name.endswith(b"*")
        data = np.frombuffer(name.rstrip(b"*"), np.uint8)
        for _, codes, weight in triples(data, np.array([0]), np.array([len(data)]), stem):
            for code in codes.tolist():
                cells.append((found.setdefault(code, len(found)), i, weight))
        norm = sizes(np.array([len(data) + (1 if stem else 2)]))[0]
        cells[:] = [(r, c, w / norm if c == i else w) for r, c, w in cells] if norm else cells
    table = np.zeros((max(len(found), 1), len(names)), np.float32)
    for r, c, w in cells:
        table[r, c] += w
    for code, r in found.items():
        rows[code] = r
    return rows, table


def train(samples: list[tuple[str, int]]) -> Machine:
    """A machine from (text, 1 if toxic) rows. With one class only, every score says that class."""
    texts, toxic = [t for t, _ in samples], np.array([int(y) for _, y in samples], np.int64)
    names = _landmarks(texts, toxic) if len(samples) else []
    rows, table = _landmark_triples(names)
    count = len(names)
    machine = Machine(names, rows, table, np.eye(count), np.zeros(count), 0.0, 1.0, 0.0)
    if not count or len(set(toxic.tolist())) < 2:
        machine.shift = 4.0 if len(toxic) and toxic.all() else -4.0
        return machine
    copies = _disguised([t for t, y in zip(texts, toxic.tolist()) if y], names[:LEAST])
    texts, toxic = texts + copies, np.append(toxic, np.ones(len(copies), np.int64))
    own = np.zeros((count, count))
    for i, name in enumerate(names):  # stems have no mark at their end
        data = np.frombuffer(name.rstrip(b"*"), np.uint8)
        stem = name.endswith(b"*")
        for _, codes, weight in triples(data, np.array([0]), np.array([len(data)]), stem):
            own[i] += table[rows[codes]].sum(0) * weight
        own[i] /= max(sizes(np.array([len(data) + (1 if stem else 2)]))[0], 1e-9)
    value, vector = np.linalg.eigh(((own + own.T) / 2) ** POWER)
    machine.root = (vector / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    points = np.concatenate([machine.text_likeness(texts[i:i + 256]) for i in range(0, len(texts), 256)]) @ machine.root
    sign = np.where(toxic == 1, 1.0, -1.0)
    share = np.where(toxic == 1, 0.5 / (toxic == 1).mean(), 0.5 / (toxic == 0).mean())
    weights, bias = np.zeros(count), 0.0
    first, second = np.zeros(count + 1), np.zeros(count + 1)
    for step in range(1, STEPS + 1):  # squared hinge loss, by a fixed number of full passes
        lack = np.maximum(0, 1 - sign * (points @ weights + bias)) * sign * share
        slope = np.append(-(points.T @ lack) / len(texts) + REGULAR * weights, -lack.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    machine.weights, machine.bias = weights, float(bias)
    margin = points @ weights + bias
    slope, shift = 1.0, 0.0
    hits = (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((toxic == 0).sum() + 2)
    aim = np.where(toxic == 1, *hits)
    for _ in range(50):  # a logistic curve through the margins
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        heat = np.maximum(p * (1 - p), 1e-9) * share
        basis = np.stack([margin, np.ones(len(margin))], 1)
        step = np.linalg.solve(basis.T @ (basis * heat[:, None]) + 1e-3 * np.eye(2), basis.T @ ((p - aim) * share))
        slope, shift = slope - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    machine.slope, machine.shift = float(slope), float(shift)
    return machine


def training_rows(
    documents: DataFrame, labels: DataFrame, learns: Column | str, *, rows: int = SAMPLE_ROWS
) -> list[tuple[str, int]]:
    """(text, toxic) of the ``rows`` labelled documents of each class whose hashed id comes first.

    A document with several labels counts as toxic if one says so.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = documents.filter(learns).select("doc_id").join(known, "doc_id").distinct()
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = ids.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows).drop("_n")
    texts = documents.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted((r.text or "", int(r.toxic)) for r in texts.select("text", "toxic").collect())


def predict(
    documents: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", rows_a_batch: int = 1024
) -> DataFrame:
    """One row per input row: doc_id, score from 0 to 1, predicted (1 if the score is at least 0.5).

    Null texts count as empty; texts without words get the score of no likeness to anything. Ids may
    repeat or be null; an empty table gives no rows. Other columns are not read.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(machine)  # LANDMARKS words and a table of triples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(at, rows_a_batch)
                score = own.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    narrow = documents.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return narrow.mapInArrow(run, "doc_id bigint, score double, predicted int")


def fit_and_predict(documents: DataFrame, labels: DataFrame, *, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Train on labelled rows outside the held-out fold, score all: doc_id, held_out, score, predicted."""
    held = fold("doc_id", folds) == held_fold
    machine = train(training_rows(documents, labels, ~held))
    return predict(documents, machine).select("doc_id", held.alias("held_out"), "score", "predicted")
