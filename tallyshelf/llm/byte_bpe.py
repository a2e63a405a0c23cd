"""Byte-level BPE encoding with a contiguous rank array, and decoding.

A text is cut into words; a word is a row of bytes. Its parts are held as a list of boundaries next to
a list of the ranks of adjacent parts. The smallest rank is looked for again and again, the boundary
between its two parts is deleted, and the ranks on both sides are refreshed. That scan is quadratic, so
words above ``SHORT`` bytes keep their pairs in a heap instead. Words are independent of each other: a
Python worker keeps the model and the words it met last, however many tasks it runs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of more bytes go through the heap; longer ones than ``KEPT`` characters are not remembered.
SHORT, KEPT = 128, 48
#: Words a worker remembers in each of two generations.
MEMO = 300_000
NONE = 1 << 40

# How text is cut into words.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that became letters or numbers after Unicode 16, the version words are cut by.
NEWER = """
    558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
    a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9
    11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
    18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81
    1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
    2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""

_words = regex.compile(WORD)
_newer = re.compile("[" + "".join("\\U{:0>8}-\\U{:0>8}".format(*r.split("-")) for r in NEWER.split()) + "]")


def split_words(text: str) -> list[str]:
    """The words of a text; together they are the text."""
    if text.isascii() or not _newer.search(text):
        return _words.findall(text)
    plain = _newer.sub("†", text)  # neither letter nor number nor space
    return [text[m.start():m.end()] for m in _words.finditer(plain)]


def byte_letters() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    own = set(shown)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Ids of words, 4 bytes each; what is missing is encoded and kept."""

    def __init__(self, model: ByteModel):
        self.model, self.older = model, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.model.merge(word.encode("utf-8", "surrogatepass"))[0].tobytes()
        if len(word) <= KEPT:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class ByteModel:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, blob: bytes):
        given = json.loads(blob)
        model, cut = given["model"], given["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if given.get("normalizer") or not plain or model.get("type") != "BPE" or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.first = [vocab[c] for c in letters]  # raises if the vocabulary lacks a byte
        added = [t for t in given.get("added_tokens") or [] if t["content"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take blanks or stand alone are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.bits = max(max(vocab.values()), 1).bit_length()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {vocab[a] << self.bits | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        self.bytes_of = [b""] * size
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
            own = [value.get(c) for c in token]
            self.bytes_of[i] = token.encode() if None in own else bytes(own)
        self.memo = Memo(self)

    def merge(self, word: bytes) -> tuple[array, list[int]]:
        """Ids of a word, and the boundaries of its parts."""
        ids = [self.first[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, bits, made = self.rank.get, self.bits, self.made
        borders = list(range(len(ids) + 1))
        ranks = [get(a << bits | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i:i + 2] = [made[best]]
            del borders[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << bits | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << bits | ids[i], NONE)
        return array("I", ids), borders

    def _merge_long(self, ids: list[int]) -> tuple[array, list[int]]:
        """The same by a heap of (rank, place); a joined part leaves -1 on its right half."""
        get, bits, end = self.rank.get, self.bits, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [
            (rank, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := get(a << bits | b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else end
            if j == end or get(ids[i] << bits | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (new := get(ids[a] << bits | ids[b])) is not None:
                    heapq.heappush(heap, (new, a))
        return array("I", [t for t in ids if t >= 0]), [i for i, t in enumerate(ids) if t >= 0] + [end]

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of text, and whether each is an added token."""
        if self.marks is None or not self.marks.search(text):
            yield text, False
        else:
            for i, part in enumerate(self.marks.split(text)):
                yield part, i % 2 == 1

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known = self.memo.__getitem__
        return b"".join(
            self.added[part] if mark else b"".join(map(known, split_words(part)))
            for part, mark in self._segments(text)
        )

    def spans(self, text: str) -> tuple[list[int], list[int]]:
        """First and end byte of the source of each id."""
        begins: list[int] = []
        ends: list[int] = []
        at = 0
        for part, mark in self._segments(text):
            for word in [part] if mark else split_words(part):
                data = word.encode("utf-8", "surrogatepass")
                borders = [0, len(data)] if mark else self.merge(data)[1]
                begins += [at + b for b in borders[:-1]]
                ends += [at + b for b in borders[1:]]
                at += len(data)
        return begins, ends

    def decode(self, ids) -> str:
        """The text of a list of ids; broken UTF-8 gives replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_models: dict[str, ByteModel] = {}


def model_of(blob: bytes) -> ByteModel:
    """The model of a file's content, built once in a Python process; the last one used is kept."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = ByteModel(blob)
    return _models[key]


def _shipped(df: DataFrame, path: str):
    with open(path, "rb") as file:  # on the driver; tasks get the bytes, a few MB whatever the corpus
        return df.sparkSession.sparkContext.broadcast(file.read())


def _numbers(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


def encode_documents(
    documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, ids, begins, ends (the source bytes each id stands for).

    Null and empty texts give empty lists. Texts are encoded whole, however long. Ids of rows may
    repeat or be null, rows are independent of each other; an empty table gives no rows. Only the two
    named columns are read, so other columns of any name do no harm. Added tokens that occur in a text
    are encoded as such, as the library does by default.
    """
    return _encoded(documents, model_path, id_col, text_col, ("ids", "begins", "ends"))


def encode_digests(
    documents: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """As ``encode_documents``, in short: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The first hash is of the ids as little-endian unsigned 32-bit integers, the second of the UTF-8
    bytes of the text that the ids decode to. Both are taken where the ids are made.
    """
    return _encoded(documents, model_path, id_col, text_col, ("n_tokens", "ids_sha256", "decoded_sha256"))


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_LONGS = pa.list_(pa.int64())
#: What can be told of an encoded text: SQL type, Arrow type, and how it is made of (model, text, ids).
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda m, t, i: _numbers(i)),
    "begins": ("array<bigint>", _LONGS, lambda m, t, i: m.spans(t)[0]),
    "ends": ("array<bigint>", _LONGS, lambda m, t, i: m.spans(t)[1]),
    "n_tokens": ("bigint", pa.int64(), lambda m, t, i: len(i) // 4),
    "ids_sha256": ("string", pa.string(), lambda m, t, i: _digest(i)),
    "decoded_sha256": (
        "string", pa.string(), lambda m, t, i: _digest(m.decode(_numbers(i).tolist()).encode("utf-8", "surrogatepass")),
    ),
}


def _encoded(documents: DataFrame, model_path: str, id_col: str, text_col: str, names: tuple[str, ...]) -> DataFrame:
    blob = _shipped(documents, model_path)
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob.value)
        makers = [COLUMNS[n] for n in names]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns: list[list] = [[] for _ in makers]
                for text in part.column(1):
                    own = text.as_py() or ""
                    ids = model.encode(own)
                    for column, (_, _, make) in zip(columns, makers):
                        column.append(make(model, own, ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, kind) for c, (_, kind, _) in zip(columns, makers))],
                    names=["doc_id", *names],
                )

    narrow = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{n} {COLUMNS[n][0]}" for n in names)]))


def decode_documents(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text its ids stand for; null and empty lists give the empty text."""
    blob = _shipped(encoded, model_path)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(blob.value)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    narrow = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return narrow.mapInArrow(run, f"doc_id {id_type}, text string")
