"""Removing words of passages that an earlier document has, with compressed FM-indexes per shard.

The way of the data is that of ``suffix_dedup``: chunks, hashes of anchors to buckets and back, then
the segments around anchors that other documents have too, to the bucket of their anchor. Each
bucket is a shard: its distinct segments are indexed, the segments of the documents are streamed over
the index, and backward search gives the matching statistics of each place. Where a match reaches the
threshold, the interval of suffixes names the documents that have it, and the smallest id decides.

Where one anchor has many distinct segments, their windows go one by one to the bucket of the hash of
all their words instead, and the smallest id of each hash decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchors import Segments, segments, window_hashes
from .chunks import (
    CROWD, MESSAGE, bucket_of, buckets_for, chunk_bytes_of, chunk_ids, codes_of, cuts, is_in, keys_elsewhere, messages,
    pack, per_bucket, per_chunk, rows_table, runs_of, sent_codes, spread, unpack, write_chunks,
)
from .fm_index import FmIndex
from .words import word_borders, word_hashes

WINDOW, GRAM = 13, 5


def _words(chunk: dict, window: int, gram: int):
    data, sizes = chunk_bytes_of(chunk)
    begin, end, counts = word_borders(data, sizes)
    found = segments(word_hashes(data, begin, end), counts, window, gram)
    owner = np.searchsorted(np.cumsum(counts), found.first, "right")
    return data, begin, end, counts, found, chunk_ids(chunk)[owner]


def _own_windows(data, begin, end, single: Segments, doc: np.ndarray, window: int):
    """(hash, id, start) of the segments' windows under the smallest id of the chunk, and starts of all others."""
    start = spread(single.first, single.last)
    doc = np.repeat(doc, single.last - single.first + 1)
    name = window_hashes(word_hashes(data, begin, end), start, window)
    rows = np.lexsort((start, doc, name))
    name, doc, start = name[rows], doc[rows], start[rows]
    head = np.append(True, name[1:] != name[:-1])[:len(rows)]
    least = doc[head][np.cumsum(head) - 1]
    return name[doc == least], doc[doc == least], start[doc == least], start[doc > least]


def _windows(sent: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """To each chunk, the spans of windows that a smaller id has, of the hashes of one bucket."""
    sender = np.concatenate([np.full(len(unpack(blob)[0]), c) for c, blob in sent])
    name, doc, start = map(np.concatenate, zip(*(unpack(blob) for _, blob in sent)))
    _, group = np.unique(name, return_inverse=True)
    least = np.full(int(group.max()) + 1, 2**63 - 1, np.int64)
    np.minimum.at(least, group, doc)
    later = np.flatnonzero(doc > least[group])
    later = later[np.argsort(sender[later], kind="stable")]
    none = np.empty(0, np.int64)
    return [(0, c, pack(*runs_of(start[later[s]], window), none, none)) for c, s in cuts(sender[later])]


def _in_two_documents(found: Segments, doc: np.ndarray) -> np.ndarray:
    """Keys that occur under two ids or more."""
    rows = np.lexsort((doc, found.key))
    key, ident = found.key[rows], doc[rows]
    return np.unique(key[1:][(key[1:] == key[:-1]) & (ident[1:] != ident[:-1])])


def smallest_document(
    strings: list[list[bytes]], docs: np.ndarray, counts: np.ndarray, window: int = WINDOW
) -> np.ndarray:
    """For each window of each string, the smallest id of the strings that have it."""
    number: dict[bytes, int] = {}
    symbols = np.array([number.setdefault(w, len(number) + 1) for s in strings for w in s], np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    index = FmIndex(symbols, sizes, len(number) + 1)
    begins = np.repeat(np.cumsum(sizes) - sizes, counts)
    begins = begins + np.arange(len(begins)) - np.repeat(np.cumsum(counts) - counts, counts)
    length, low, high = index.matches(symbols, begins, np.full(len(begins), window))
    smallest = np.repeat(docs, counts)
    reached = length >= window
    # intervals of equal length are apart or the same
    lows, where, inverse = np.unique(low[reached], return_index=True, return_inverse=True)
    highs = high[reached][where]
    edges = np.stack([lows, highs], 1).ravel()
    by_place = np.append(docs[index.owner], np.int64(2**63 - 1))
    smallest[reached] = np.minimum.reduceat(by_place, edges)[::2][inverse]
    return smallest


def _shard(sent: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, bytes]]:
    """To each chunk, the runs of windows that a smaller id has: (segment, first, last window)."""
    chunk, key, doc, first, count, text = [], [], [], [], [], []
    for sender, blob in sent:
        keys, docs, firsts, counts, rels, sizes, data = unpack(blob)
        stop = np.cumsum(sizes).tolist()
        text += [(r, b" ".join(data[e - n:e].split())) for r, e, n in zip(rels.tolist(), stop, sizes.tolist())]
        chunk.append(np.full(len(keys), sender))
        key.append(keys), doc.append(docs), first.append(firsts), count.append(counts)
    chunk, key, doc, first, count = map(np.concatenate, (chunk, key, doc, first, count))
    number: dict[tuple[int, bytes], int] = {}
    same = np.array([number.setdefault(t, len(number)) for t in text], np.int64)
    least = np.full(len(number), 2**63 - 1, np.int64)
    np.minimum.at(least, same, doc)
    lead = np.unique(same, return_index=True)[1]
    counts = count[lead]
    smallest = np.repeat(least, counts)
    _, group, members = np.unique(key[lead], return_inverse=True, return_counts=True)
    mixed_groups = members[group] > 1  # others hold one text only: its smallest id is known
    if mixed_groups.any():
        names = list(number)
        strings = [names[i][1].split(b" ") for i in np.flatnonzero(mixed_groups).tolist()]
        smallest[np.repeat(mixed_groups, counts)] = smallest_document(
            strings, least[mixed_groups], counts[mixed_groups], window
        )
    offset = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(chunk)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    taken = smallest[offset[same[row]] + place] < doc[row]
    border = np.append(True, row[1:] != row[:-1])
    begin = np.flatnonzero(taken & (border | ~np.append(False, taken[:-1])))
    end = np.flatnonzero(taken & np.append(border[1:] | ~taken[1:], True))
    to, at = chunk[row[begin]], first[row[begin]]
    rows = np.argsort(to, kind="stable")
    return [
        (0, c, pack(at[rows[s]], place[begin[rows[s]]], place[end[rows[s]]])) for c, s in cuts(to[rows])
    ]


def _removed(documents: DataFrame, run, schema: str, window: int, options: dict) -> DataFrame:
    gram = min(GRAM, window)
    crowd = options.pop("crowd", CROWD)
    chunks = write_chunks(documents, **options)
    count = buckets_for(chunks)
    plain = chunks.select("chunk", "ids", "sizes", "data")

    def keys(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
        found = _words(chunk, window, gram)[4]
        return found.key, found.content

    repeated = keys_elsewhere(plain, keys, count, crowd)

    def around(chunk: dict, sent: list[bytes]) -> pa.Table:
        data, begin, end, _, found, doc = _words(chunk, window, gram)
        codes = codes_of(found.key, count)
        shared, full = sent_codes(sent)
        known = is_in(codes, shared) | is_in(found.key, _in_two_documents(found, doc))
        crowded = is_in(codes, full)
        single, single_doc = found.take(np.flatnonzero(crowded)), doc[crowded]
        rows = np.flatnonzero(known & ~crowded)
        found, doc = found.take(rows), doc[rows]
        if not len(found) and not len(single):
            return messages([])
        # of equal segments, those under the smallest id stand for what other chunks may have
        rows = np.lexsort((found.first, doc, found.content))
        head = np.ones(len(rows), bool)
        head[1:] = found.content[rows][1:] != found.content[rows][:-1]
        lead = rows[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = doc[rows] > doc[lead]
        twin = ~head & ~later
        # spans known here go the same way, in buckets that hand them on
        name, ids, start, gone = _own_windows(data, begin, end, single, single_doc, window)
        first, stop = runs_of(gone, window)
        out = [(count + chunk["chunk"] % count, chunk["chunk"], pack(
            np.append(found.first[rows[later]], first), np.append(found.last[rows[later]] + window, stop),
            found.first[lead[twin]], found.first[rows[twin]],
        ))]
        for b, s in cuts(bucket_of(name, count)):
            out.append((2 * count + b, chunk["chunk"], pack(name[s], ids[s], start[s])))
        own = rows[head]
        own = own[np.argsort(found.key[own], kind="stable")]
        raw = data.tobytes()
        for b, s in cuts(bucket_of(found.key[own], count)):
            part = own[s]
            first, last = found.first[part], found.last[part]
            lo, hi = begin[first], end[last + window - 1]
            text = b"".join([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())])
            out.append((b, chunk["chunk"], pack(
                found.key[part], doc[part], first, last - first + 1, found.place[part] - first, hi - lo, text
            )))
        return messages(out)

    def shard(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        if bucket >= 2 * count:
            return _windows(rows, window)
        return [(0, c, p) for c, p in rows] if bucket >= count else _shard(rows, window)

    letters = per_bucket(per_chunk(plain, repeated, around, MESSAGE), shard)

    def cut(chunk: dict, parts: list[bytes]) -> pa.Table:
        data, sizes = chunk_bytes_of(chunk)
        begin, end, counts = word_borders(data, sizes)
        edge = np.zeros(len(begin) + 1, np.int64)
        twins, runs = [], []
        for part in map(unpack, parts):
            if len(part) == 4:
                np.add.at(edge, part[0], 1)
                np.add.at(edge, part[1], -1)
                twins.append(part[2:])
            else:
                runs.append(part)
        for segment, first, last in runs:
            np.add.at(edge, segment + first, 1)
            np.add.at(edge, segment + last + window, -1)
        if twins and runs:
            of, twin = map(np.concatenate, zip(*twins))
            segment, first, last = map(np.concatenate, zip(*runs))
            rows = np.argsort(segment, kind="stable")
            segment, first, last = segment[rows], first[rows], last[rows]
            lo, hi = np.searchsorted(segment, of, "left"), np.searchsorted(segment, of, "right")
            many = hi - lo
            pick = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            base = np.repeat(twin, many)
            np.add.at(edge, base + first[pick], 1)
            np.add.at(edge, base + last[pick] + window, -1)
        return run(chunk, data, sizes, begin, end, counts, np.cumsum(edge[:-1]) > 0)

    return per_chunk(plain, letters, cut, schema)


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, text string"


def _kept(chunk, data, sizes, counts, removed):
    """(id, words, words removed, kept words joined by a space) of each text."""
    raw, at, word = data.tobytes(), 0, 0
    for ident, size, count in zip(chunk["ids"], sizes.tolist(), counts.tolist()):
        words = raw[at:at + size].split()
        gone = removed[word:word + count]
        lost = int(gone.sum())
        if lost:
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        yield ident, count, lost, b" ".join(words)
        at, word = at + size, word + count


def repeat_digests(documents: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and the digest of the words kept.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id.
    Null texts have no words; texts of fewer words keep all. A null id is smaller than all others;
    rows that share an id never remove from each other. An empty table gives no rows. Columns other
    than ``id_col`` and ``text_col`` are not read.
    """

    def run(chunk, data, sizes, begin, end, counts, removed):
        rows = [(i, n, r, hashlib.sha256(t).hexdigest()) for i, n, r, t in _kept(chunk, data, sizes, counts, removed)]
        return rows_table(rows, DIGEST)

    return _removed(documents, run, DIGEST, window, options)


def without_repeats(documents: DataFrame, *, window: int = WINDOW, **options) -> DataFrame:
    """As ``repeat_digests``, with the kept words joined by one space instead of their digest."""

    def run(chunk, data, sizes, begin, end, counts, removed):
        rows = [(i, n, r, t.decode("utf-8", "replace")) for i, n, r, t in _kept(chunk, data, sizes, counts, removed)]
        return rows_table(rows, KEPT)

    return _removed(documents, run, KEPT, window, options)


SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), starts AS (
  SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM texts WHERE len(words) >= 13
), windows AS (
  SELECT r, doc_id, p, md5_number(array_to_string(list_slice(words, p, p + 12), ' ')) AS w FROM starts
), repeats AS (
  SELECT r, p FROM (
    SELECT r, p, doc_id, min(coalesce(doc_id, -9223372036854775808)) OVER (PARTITION BY w) AS least FROM windows
  ) WHERE least < doc_id
), gone AS (
  SELECT r, list(DISTINCT p + k) AS places FROM repeats, range(13) AS t(k) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE
         list_filter(words, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN gone USING (r)
"""
