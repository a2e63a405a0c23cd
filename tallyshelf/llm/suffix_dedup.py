"""Removing bytes that repeat an earlier passage, with suffix arrays over the shards of the corpus.

1. Texts are packed into chunks. Every window of ``window`` bytes picks an anchor (``anchors``); the
   hashes of anchors go to buckets, which tell each chunk which of them occur elsewhere too. What has
   no such anchor cannot repeat, and rests.
2. The segments around repeated anchors, made distinct within the chunk, go to the bucket of their
   hash. Equal windows meet there. The bucket is a shard: its distinct segments are cut into tokens
   at places their content picks, and the suffix array over the tokens (``suffixes``) brings windows
   with equal insides together; with equal borders they are the same window.
3. Each shard tells the chunks which windows start earlier elsewhere; the chunks cut their bytes.

Segments that reach over the edge of a passage differ from copy to copy. Where one anchor has many
distinct segments, their windows go one by one to the bucket of the hash of all their bytes instead:
equal windows meet there, windows with own bytes spread over all buckets. Inside a passage, each chunk
sends its first window only.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Segments, hashes, mixed, prefix_sums, segments, window_hashes
from .chunks import (
    CROWD, MESSAGE, bucket_of, buckets_for, chunk_bytes_of, chunk_ids, codes_of, cuts, is_in, keys_elsewhere, messages,
    pack, per_bucket, per_chunk, rest_of, rows_table, runs_of, sent_codes, spread, unpack, write_chunks,
)
from .suffixes import shared_prefixes, suffix_array

WINDOW, GRAM = 100, 40
#: Tokens of the suffix array: cut at the smallest 4-byte hash of every 16 bytes.
CUT_WINDOW, CUT_GRAM = 16, 4


def window_classes(texts: list[bytes], counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Class of each window: equal numbers, equal bytes. ``counts`` windows start in each text.

    A window's own bytes decide where it is cut. Between its first and last cut it is a run of
    tokens, and windows with equal runs are neighbours in the suffix array of all tokens; before the
    first and behind the last cut fewer than ``CUT_WINDOW`` bytes are left, which are compared as such.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    small = segments(data, sizes, CUT_WINDOW, CUT_GRAM)
    cut_at = np.zeros(len(data), np.int64)
    width = small.last - small.first + 1
    spread = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    cut_at[np.repeat(small.first, width) + spread] = np.repeat(small.place, width)
    places = np.unique(small.place)
    owner = np.searchsorted(begins, places, "right") - 1
    with np.errstate(over="ignore"):
        sums = prefix_sums(data)
        follows = np.append(owner[1:] == owner[:-1], False)
        ends = np.append(places[1:], places[-1:])
        token = np.zeros(len(places), np.int64)
        inside = mixed(hashes(sums, places[follows], ends[follows]) + (ends - places)[follows].astype(np.uint64))
        token[follows] = np.unique(inside, return_inverse=True)[1] + 1
        order = np.array(suffix_array(token.tolist()), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))

        start = np.repeat(begins, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        first, last = cut_at[start], cut_at[start + window - CUT_WINDOW]
        head, tail = np.searchsorted(places, first), np.searchsorted(places, last)
        depth = tail - head
        shared = shared_prefixes(token, order, int(depth.max(initial=0)))
        run = np.zeros(len(start), np.int64)
        for d in np.unique(depth):
            own = depth == d
            border = np.where(shared < d, np.arange(len(order)), 0)
            run[own] = np.maximum.accumulate(border)[rank[head[own]]]
        left = mixed(hashes(sums, start, first) + (first - start).astype(np.uint64))
        right = hashes(sums, last, start + window)
        name = mixed(mixed(left ^ mixed(right)) + run.astype(np.uint64) * np.uint64(4096) + depth.astype(np.uint64))
    return np.unique(name, return_inverse=True)[1]


def _distinct(found: Segments, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of each content, all others), rows of ``found``; ``order`` sorts documents."""
    rows = np.lexsort((found.first, order, found.content))
    head = np.ones(len(rows), bool)
    head[1:] = found.content[rows][1:] != found.content[rows][:-1]
    return rows[head], rows[~head]


def _spans(flags: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of true flags; a run ends where ``border`` is true on the next."""
    before = np.append(False, flags[:-1])
    begin = np.flatnonzero(flags & (~before | border))
    after = np.append(flags[1:] & ~border[1:], False)
    return begin, np.flatnonzero(flags & ~after)


def _shard(sent: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """Spans that each chunk has to remove, from the segments that the chunks sent to one bucket."""
    chunk, key, doc, first, count, text = [], [], [], [], [], []
    for sender, blob in sent:
        keys, docs, firsts, counts, rels, data = unpack(blob)
        size = counts + window - 1
        stop = np.cumsum(size).tolist()
        # equal bytes around anchors at different offsets are kept apart by the offset in front
        text += [(r, data[e - n:e]) for r, e, n in zip(rels.tolist(), stop, size.tolist())]
        chunk.append(np.full(len(keys), sender))
        key.append(keys), doc.append(docs), first.append(firsts), count.append(counts)
    chunk, key, doc, first, count = map(np.concatenate, (chunk, key, doc, first, count))
    number: dict[tuple[int, bytes], int] = {}
    same = np.array([number.setdefault(t, len(number)) for t in text], np.int64)
    rows = np.lexsort((first, chunk, doc, same))
    head = np.ones(len(rows), bool)
    head[1:] = same[rows][1:] != same[rows][:-1]
    later = rows[~head]
    out = [(chunk[later], first[later], first[later] + count[later] + window - 1)]

    lead = rows[head]  # the earliest occurrence of each distinct segment
    _, group, members = np.unique(key[lead], return_inverse=True, return_counts=True)
    lead = lead[members[group] > 1]
    if len(lead):
        names = list(number)
        counts = count[lead]
        classes = window_classes([names[same[i]][1] for i in lead.tolist()], counts, window)
        owner = np.repeat(np.arange(len(lead)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows = np.lexsort((first[lead][owner] + offset, chunk[lead][owner], doc[lead][owner], classes))
        repeats = np.zeros(len(owner), bool)
        repeats[rows[1:]] = classes[rows][1:] == classes[rows][:-1]
        begin, end = _spans(repeats, np.append(True, owner[1:] != owner[:-1]))
        base = first[lead][owner[begin]]
        out.append((chunk[lead][owner[begin]], base + offset[begin], base + offset[end] + window))
    to, begin, end = map(np.concatenate, zip(*out))
    rows = np.argsort(to, kind="stable")
    to, begin, end = to[rows], begin[rows], end[rows]
    return [(0, c, pack(begin[s], end[s])) for c, s in cuts(to)]


def _windows(sent: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """Spans that each chunk has to remove, from the windows with the hashes of one bucket."""
    sender = np.concatenate([np.full(len(unpack(blob)[0]), c) for c, blob in sent])
    name, doc, start = map(np.concatenate, zip(*(unpack(blob) for _, blob in sent)))
    rows = np.lexsort((start, sender, doc, name))
    later = rows[1:][name[rows][1:] == name[rows][:-1]]
    later = later[np.argsort(sender[later], kind="stable")]
    return [(0, c, pack(*runs_of(start[later[s]], window))) for c, s in cuts(sender[later])]


def _removed(documents: DataFrame, run, schema: str, window: int, keep: bool, options: dict) -> DataFrame:
    """``run(chunk, bytes, sizes, removed)`` of every chunk, where ``removed`` flags bytes."""
    gram = min(GRAM, max(1, 2 * window // 5))
    if window < CUT_WINDOW + 1:
        raise ValueError(f"the window has to be longer than {CUT_WINDOW} bytes")
    crowd = options.pop("crowd", CROWD)
    chunks = write_chunks(documents, keep=keep, **options)
    count = buckets_for(chunks)

    def keys(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
        found = segments(*chunk_bytes_of(chunk), window, gram)
        return found.key, found.content

    plain = chunks.select("chunk", "ids", "sizes", "data")
    repeated = keys_elsewhere(plain, keys, count, crowd)

    def around(chunk: dict, sent: list[bytes]) -> pa.Table:
        data, sizes = chunk_bytes_of(chunk)
        found = segments(data, sizes, window, gram)
        codes = codes_of(found.key, count)
        shared, full = sent_codes(sent)
        elsewhere, crowded = is_in(codes, shared), is_in(codes, full)
        names, inverse, counts = np.unique(found.key, return_inverse=True, return_counts=True)
        single = found.take(np.flatnonzero(crowded))
        found = found.take(np.flatnonzero(((counts[inverse] > 1) | elsewhere) & ~crowded))
        if not len(found) and not len(single):
            return messages([])
        ids, stops = chunk_ids(chunk), np.cumsum(sizes)
        order = np.empty(len(ids), np.int64)
        order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        start = spread(single.first, single.last)
        name, text_of = window_hashes(data, start, window), np.searchsorted(stops, start, "right")
        first = np.lexsort((start, order[text_of], name))
        head = np.append(True, name[first][1:] != name[first][:-1])[:len(first)]
        begin, end = runs_of(start[first[~head]], window)
        owner = np.searchsorted(stops, found.first, "right")
        lead, others = _distinct(found, order[owner])
        # spans known here go the same way, in buckets that hand them on
        spans = pack(np.append(found.first[others], begin), np.append(found.last[others] + window, end))
        rows = [(count + chunk["chunk"] % count, chunk["chunk"], spans)]
        first = first[head]
        for b, s in cuts(bucket_of(name[first], count)):
            own = first[s]
            rows.append((2 * count + b, chunk["chunk"], pack(name[own], ids[text_of[own]], start[own])))
        lead = lead[np.argsort(found.key[lead], kind="stable")]
        bucket = bucket_of(found.key[lead], count)
        raw = data.tobytes()
        for b, s in cuts(bucket):
            own = lead[s]
            first, last = found.first[own], found.last[own]
            text = b"".join([raw[f:e] for f, e in zip(first.tolist(), (last + window).tolist())])
            rows.append((b, chunk["chunk"], pack(
                found.key[own], ids[owner[own]], first, last - first + 1, found.place[own] - first, text
            )))
        return messages(rows)

    def shard(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        if bucket >= 2 * count:
            return _windows(rows, window)
        if bucket >= count:
            return [(0, c, p) for c, p in rows]
        gc.disable()  # many small lists, no cycles
        try:
            return _shard(rows, window)
        finally:
            gc.enable()

    spans = per_bucket(per_chunk(plain, repeated, around, MESSAGE), shard)

    def cut(chunk: dict, parts: list[bytes]) -> pa.Table:
        data, sizes = chunk_bytes_of(chunk)
        edge = np.zeros(len(data) + 1, np.int64)
        for begin, end in map(unpack, parts):
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)
        return run(chunk, data, sizes, np.cumsum(edge[:-1]) > 0)

    return per_chunk(chunks, spans, cut, schema)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([[False], flags, [False]])
    return np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(~padded[1:] & padded[:-1])


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def repeat_digests(documents: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes kept.

    A byte goes if a ``window``-byte string over it also starts earlier: under a smaller id, or
    earlier in the same text. Null texts count as empty; texts shorter than the window keep all.
    Null ids come before all others; rows that share an id are ordered as they are stored. An empty
    table gives no rows. Columns other than ``id_col`` and ``text_col`` are not read.
    """

    def run(chunk, data, sizes, removed):
        out, end = [], 0
        for ident, size in zip(chunk["ids"], sizes.tolist()):
            begin, end = end, end + size
            gone = removed[begin:end]
            kept = data[begin:end][~gone].tobytes()
            out.append((ident, size, int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
        return rows_table(out, DIGEST)

    return _removed(documents, run, DIGEST, window, False, options)


SPANS = "doc_id bigint, n_bytes bigint, begins array<bigint>, ends array<bigint>"


def repeat_spans(documents: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """As ``repeat_digests``, with the removed byte spans themselves: doc_id, n_bytes, begins, ends."""

    def run(chunk, data, sizes, removed):
        out, end = [], 0
        for ident, size in zip(chunk["ids"], sizes.tolist()):
            begin, end = end, end + size
            first, last = _runs(removed[begin:end])
            out.append((ident, size, first.tolist(), last.tolist()))
        return rows_table(out, SPANS)

    return _removed(documents, run, SPANS, window, False, options)


def without_repeats(documents: DataFrame, *, window: int = WINDOW, text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated passages cut out of ``text_col``; all other columns as given.

    Where a cut runs through a character of several bytes, the rest of that character goes too. Null
    texts stay null.
    """
    others = [f for f in documents.schema.fields if f.name != text_col]
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others)

    def run(chunk, data, sizes, removed):
        texts, end = [], 0
        for size in chunk["sizes"]:
            begin, end = end, end + max(size, 0)
            kept = data[begin:end][~removed[begin:end]].tobytes()
            texts.append(None if size < 0 else kept.decode("utf-8", "ignore"))
        return pa.table({"_text": pa.array(texts, pa.string()), "_rest": rest_of(chunk["rest"]).combine_chunks()})

    cut = _removed(documents, run, f"_text string, _rest struct<{row}>", window, True, {"text_col": text_col, **options})
    return cut.select(*[
        F.col("_text").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in documents.columns
    ])


SQL = """
WITH bytes AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS hex FROM documents
), starts AS (
  SELECT r, doc_id, unnest(range(0, length(hex) // 2 - 99)) AS p, hex FROM bytes WHERE length(hex) >= 200
), windows AS (
  SELECT r, doc_id, p, md5_number(substr(hex, 2 * p + 1, 200)) AS w FROM starts
), repeats AS (
  SELECT r, p FROM (
    SELECT r, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, r, p) AS n FROM windows
  ) WHERE n > 1
), islands AS (
  SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM repeats
), numbered AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS island FROM islands
), spans AS (
  SELECT r, island, min(p) AS b, max(p) + 100 AS e FROM numbered GROUP BY r, island
), gaps AS (
  SELECT r, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS before FROM spans
), kept AS (
  SELECT g.r, string_agg(substr(hex, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head,
         max(e) AS last, sum(e - b) AS n_removed, count(*) AS n_spans
  FROM gaps g JOIN bytes USING (r) GROUP BY g.r
)
SELECT doc_id, CAST(length(hex) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hex, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN kept USING (r)
"""
