"""SentencePiece BPE encoding that keeps source offsets, and decoding."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
#: Words a task remembers with their pieces; longer words are never kept.
CACHE_WORDS, CACHE_CHARS = 150_000, 64
NONE = float("-inf")
FIRST, SECOND = itemgetter(0), itemgetter(1)
NO_RANK = np.int32(2**31 - 1)


def _each_byte(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


def _row_bytes(numbers) -> bytes:
    return np.asarray(numbers, np.int32).tobytes()


class CharMap:
    """The compiled normalisation map: a double-array trie over UTF-8 bytes and the texts it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, str] | None:
        """(bytes matched, replacement) of the longest key that starts at ``at``."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1]:end].decode()


class PieceModel:
    """Pieces, scores and normalisation rules of one model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        rules = model.normalizer_spec
        self.map = CharMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.escape = rules.escape_whitespaces
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER, UNUSED)}
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.end = next((i for i, (p, _, _) in enumerate(pieces) if p == "</s>"), None)
        self.control = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        self.leads = {i for i, (p, _, kind) in enumerate(pieces) if p.startswith(SPACE) and kind != BYTE}
        self.bytes_of = [
            b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE
            else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        # Pieces never hold a space mark after another character, so no merge crosses the start of a
        # run of marks; a line end that is in no longer piece cuts too.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        line = "" if any("\n" in p and len(p) > 1 for p in self.score) else "\n"
        self.word = re.compile(rf"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|{line or '(?!)'}")
        self.single = {
            p: (i, len(p.encode()) - 2 * p.count(SPACE)) for p, i in self.ids.items()
        }
        self.length = [len(p) for p, _, _ in pieces]
        self._rank_pairs(len(pieces))
        #: Words with their ids and the widths of their pieces, each as 32-bit numbers in a row.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _rank_pairs(self, count: int) -> None:
        """Every pair of pieces that joins to a piece, as sorted numbers, with its rank by score."""
        order = {v: r for r, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = sorted(
            (self.ids[p[:i]] * count + self.ids[p[i:]], order[v], self.ids[p])
            for p, v in self.score.items() for i in range(1, len(p))
            if p[:i] in self.ids and p[i:] in self.ids
        )
        table = np.array(pairs or [(-1, 0, 0)], dtype=np.int64)
        self.pair, self.pair_rank, self.pair_id = (
            np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        )
        self.count = count
        self.text_of = [str(i) for i in range(count)]
        self.character = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.character[ord(p)] = i
        # pieces of two unknown characters or more would merge without ids; then words go one by one
        self.batches = all(c in self.ids for p in self.score for c in p)
        self.width = np.zeros(count, np.int64)
        for i, w in self.single.values():
            self.width[i] = w

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.count + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NO_RANK), self.pair_id[at]

    def learn(self, words: Iterable[str]) -> None:
        """Remember the pieces of many words at once: words of one length are merged in step."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            if len(word) <= CACHE_CHARS and word not in self.known:
                if (entry := self.older.get(word)) is not None:
                    self.known[word] = entry
                else:
                    by_length.setdefault(len(word), []).append(word)
        for length, alike in by_length.items():
            codes = "".join(alike).encode("utf-32-le", "surrogatepass")
            pieces = self.character[np.frombuffer(codes, np.uint32).reshape(-1, length)]
            usable = (pieces >= 0).all(1) if self.batches else np.zeros(len(alike), bool)
            for i in np.flatnonzero(~usable).tolist():
                self.known[alike[i]] = self.word_pieces(alike[i])
            for where, ids in self._merge_many(pieces[usable]):
                own, widths, size = _row_bytes(ids), _row_bytes(self.width[ids]), 4 * ids.shape[1]
                for at, i in enumerate(np.flatnonzero(usable)[where].tolist()):
                    span = slice(at * size, (at + 1) * size)
                    self.known[alike[i]] = own[span], widths[span]
        if len(self.known) >= CACHE_WORDS:
            self.known, self.older = {}, self.known

    def _merge_many(self, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) as rows end; each step joins the best pair of every row that has one."""
        where = np.arange(len(pieces))
        rank, joined = self._ranked(pieces[:, :-1], pieces[:, 1:])
        while len(pieces):
            if pieces.shape[1] == 1:
                yield where, pieces
                return
            best = rank.argmin(1)
            rows = np.arange(len(pieces))
            more = rank[rows, best] != NO_RANK
            if not more.all():
                yield where[~more], pieces[~more]
                where, pieces, rank, joined, best = where[more], pieces[more], rank[more], joined[more], best[more]
                rows = np.arange(len(pieces))
                if not len(pieces):
                    return
            column = np.arange(pieces.shape[1] - 1)
            merged = joined[rows, best]
            pieces = np.take_along_axis(pieces, column + (column > best[:, None]), 1)
            pieces[rows, best] = merged
            column = column[:-1]
            shift = column + (column >= best[:, None])
            rank, joined = np.take_along_axis(rank, shift, 1), np.take_along_axis(joined, shift, 1)
            for at in (best - 1, best):  # the pairs on both sides of the joined piece are new
                own = np.flatnonzero((at >= 0) & (at < len(column)))
                at = at[own]
                rank[own, at], joined[own, at] = self._ranked(pieces[own, at], pieces[own, at + 1])

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The text the merges see, and for each of its characters the source byte it comes from.

        The list has one more entry, the end of the source. Characters put in front have no source.
        """
        data = text.encode("utf-8", "surrogatepass")
        mark = SPACE if self.escape else " "
        out: list[str] = []
        source: list[int] = []

        def put(piece: str, at: int) -> None:
            for c in piece:
                out.append(mark if c == " " else c)
                source.append(at)

        at, spaced = 0, self.squeeze
        started = False
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found is None:
                lead = data[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = width, data[at:at + width].decode("utf-8", "surrogatepass")
            width, piece = found
            if spaced:
                piece = piece.lstrip(" ")
            if piece:
                if not started and self.prefix:
                    put(" ", at)
                started = True
                put(piece, at)
                spaced = self.squeeze and piece.endswith(" ")
            at += width
        if self.squeeze:
            while out and out[-1] == mark:
                out.pop()
                source.pop()
                at = source[len(out)] if len(out) < len(source) else at
        return "".join(out), [*source, len(data)]

    def merge(self, word: str) -> list[str]:
        """Join the best-scored pair, leftmost first, until no pair is a piece."""
        if len(word) > CACHE_CHARS:
            return self._merge_long(word)
        parts, score = list(word), self.score.get
        pairs = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != NONE:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NONE)
        return parts

    def _merge_long(self, word: str) -> list[str]:
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if (s := self.score.get(both)) is not None:
                    heapq.heappush(heap, (-s, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def word_pieces(self, word: str) -> tuple[bytes, bytes]:
        """Ids, and the source bytes each covers if a mark stands for a space, as 32-bit numbers."""
        parts, single = self.merge(word), self.single
        ids: list[int] = []
        widths: list[int] = []
        for part in parts:
            if part in single:
                ids.append(single[part][0])
                widths.append(single[part][1])
            else:
                data = part.encode("utf-8", "surrogatepass")
                if self.byte_ids:  # an unknown character: bytes, the last has the span
                    ids += [self.byte_ids[b] for b in data]
                    widths += [0] * (len(data) - 1) + [len(data)]
                else:
                    ids.append(self.unknown)
                    widths.append(len(data))
        return _row_bytes(ids), _row_bytes(widths)

    def _words(self, names: list[str]) -> list:
        new, old, found = self.known, self.older, []
        for word in names:
            entry = new.get(word)
            if entry is None:
                entry = old.get(word) or self.word_pieces(word)
                if len(word) <= CACHE_CHARS:
                    if len(new) >= CACHE_WORDS:
                        self.known, self.older = new, old = {}, new
                    new[word] = entry
            found.append(entry)
        return found

    def _characters(self, ids, widths) -> list[int]:
        """Characters of the normalised text each piece covers."""
        byte = set(self.byte_ids.values())
        return [
            (w > 0) if i in byte else 1 if i == self.unknown else self.length[i] for i, w in zip(ids, widths)
        ]

    def prepare(self, text: str) -> tuple[list[str], list[int] | None]:
        """The words the merges see; the sources of their characters unless a width says it all."""
        if self.map is None and not self.squeeze and self.escape and SPACE not in text:
            normal, source = (SPACE if self.prefix and text else "") + text.replace(" ", SPACE), None
        else:
            normal, source = self.normalise(text)
        return self.word.findall(normal) if self.cuts else [normal] * bool(normal), source

    def encode(self, text: str, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the byte spans [begin, end) of the source each id stands for."""
        return self.encode_words(*self.prepare(text), end)

    def encode_words(
        self, names: list[str], source: list[int] | None, end: bool = True
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = self._words(names)
        ids = np.frombuffer(b"".join(map(FIRST, words)), np.int32)
        widths = np.frombuffer(b"".join(map(SECOND, words)), np.int32).astype(np.int64)
        if source is None:
            if self.prefix and len(widths):  # the mark put in front has no source
                widths[0] -= 1
            borders = np.append(0, np.cumsum(widths))
        else:
            places = accumulate(self._characters(ids.tolist(), widths.tolist()), initial=0)
            borders = np.array([source[p] for p in places], np.int64)
        if end and self.end is not None:
            ids, borders = np.append(ids, np.int32(self.end)), np.append(borders, borders[-1])
        return ids, borders[:-1], borders[1:]

    def encode_many(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        prepared = [self.prepare(text) for text in texts]
        self.learn(set(chain.from_iterable(map(FIRST, prepared))))
        return (self.encode_words(*p) for p in prepared)

    def decode(self, ids) -> str:
        """The text of a list of ids; broken UTF-8 gives one replacement character a byte."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        if first in self.leads and (self.prefix or self.squeeze):
            data = data.lstrip(b" ") if self.squeeze else data[1:]
        return data.decode("utf-8", "each_byte")


_models: dict[str, PieceModel] = {}


def model_of(blob: bytes) -> PieceModel:
    """The model of a file's content with the words it met, kept by a Python worker from task to task."""
    key = _digest(blob)
    if key not in _models:
        _models.clear()  # one model at a time
        _models[key] = PieceModel(blob)
    return _models[key]


def encode_documents(
    documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    rows_a_batch: int = 256,
) -> DataFrame:
    """One row per input row: doc_id, ids (with the end id), begins, ends (source byte spans).

    Null texts count as empty and give the end id alone. Ids may repeat or be null, rows are
    independent of each other; an empty table gives no rows. Only the two named columns are read.
    """
    return _encoded(documents, model_path, id_col, text_col, rows_a_batch, ("ids", "begins", "ends"))


def encode_digests(
    documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False,
    rows_a_batch: int = 512,
) -> DataFrame:
    """As ``encode_documents``, lists in short: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    The lists are hashed where they are made, so that they need not leave the task; with ``ids`` the
    ids come along. ``n_bytes`` is the end of the last span, the length of the source.
    """
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", *(["ids"] if ids else []))
    return _encoded(documents, model_path, id_col, text_col, rows_a_batch, names)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: What can be told of an encoded text: type, Arrow type, and how it is made of (model, ids, begins, ends).
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda m, i, b, e: i),
    "begins": ("array<bigint>", pa.list_(pa.int64()), lambda m, i, b, e: b),
    "ends": ("array<bigint>", pa.list_(pa.int64()), lambda m, i, b, e: e),
    "n_tokens": ("bigint", pa.int64(), lambda m, i, b, e: len(i)),
    "ids_sha256": ("string", pa.string(), lambda m, i, b, e: _digest(" ".join(map(m.text_of.__getitem__, i.tolist())).encode())),
    "decoded_sha256": ("string", pa.string(), lambda m, i, b, e: _digest(m.decode(i.tolist()).encode("utf-8", "surrogatepass"))),
    "n_bytes": ("bigint", pa.int64(), lambda m, i, b, e: int(e[-1]) if len(e) else 0),
}


def _encoded(
    documents: DataFrame, model_path: str, id_col: str, text_col: str, rows_a_batch: int, names: tuple[str, ...]
) -> DataFrame:
    with open(model_path, "rb") as file:  # on the driver; tasks get the bytes
        blob = documents.sparkSession.sparkContext.broadcast(file.read())
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob.value)
        makers = [COLUMNS[n] for n in names]
        for batch in batches:
            for at in range(0, batch.num_rows, rows_a_batch):
                part = batch.slice(at, rows_a_batch)
                columns: list[list] = [[] for _ in makers]
                for ids, begins, ends in model.encode_many([t or "" for t in part.column(1).to_pylist()]):
                    for column, (_, _, make) in zip(columns, makers):
                        column.append(make(model, ids, begins, ends))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, kind) for c, (_, kind, _) in zip(columns, makers))],
                    names=["doc_id", *names],
                )

    narrow = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{n} {COLUMNS[n][0]}" for n in names)]))


def decode_documents(
    encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """doc_id and the text its ids stand for; null or empty lists give the empty text."""
    with open(model_path, "rb") as file:
        blob = encoded.sparkSession.sparkContext.broadcast(file.read())
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        model = model_of(blob.value)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    narrow = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, text string")
