"""Anchors: places picked by content alone, so that equal windows of a sequence pick the same ones.

A window of ``size`` symbols takes its smallest hash over ``gram`` symbols, leftmost first. Two equal
windows hence hold equal anchors at equal offsets, and whatever has no anchor in common with another
place repeats nowhere. Windows that follow each other and share their anchor make a segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Sequences are hashed in blocks of so many symbols, which bounds memory.
BLOCK = 1 << 18
PLACE_BITS = np.uint64(20)


def _powers(count: int, base: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.ones(count, np.uint64)
    step, filled = np.uint64(base), 1
    while filled < count:
        take = min(filled, count - filled)
        out[filled:filled + take] = out[:take] * step
        step, filled = step * step, filled + take
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, count: int = 256) -> np.ndarray:
    """Powers of the base, of its inverse, or the numbers that stand for bytes; the first ``count``."""
    if name not in _tables or len(_tables[name]) < count:
        with np.errstate(over="ignore"):
            if name == "byte":
                _tables[name] = np.random.default_rng(11).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
            else:
                base = int(BASE) if name == "power" else pow(int(BASE), -1, 2**64)
                _tables[name] = _powers(max(count, BLOCK + 4096), base)
    return _tables[name][:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(32))) * MIX
    return (values ^ (values >> np.uint64(29))) * MIX


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums of bytes or 64-bit symbols."""
    if symbols.dtype == np.uint8:
        symbols = _table("byte")[symbols]
    out = np.empty(len(symbols) + 1, np.uint64)
    out[0] = 0
    np.cumsum(symbols * _table("power", len(symbols)), out=out[1:])
    return out


def hashes(sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of symbols begin to end, for many pairs."""
    return (sums[end] - sums[begin]) * _table("inverse", len(sums))[begin]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


@dataclass
class Segments:
    """Windows starting at first..last (symbols of the chunk) share the anchor ``place`` (hash ``key``)."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    key: np.ndarray
    content: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(*(getattr(self, n)[rows] for n in ("first", "last", "place", "key", "content")))


def segments(symbols: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> Segments:
    """Segments of all whole windows of consecutive sequences with ``sizes`` symbols.

    ``symbols`` are bytes or 64-bit hashes of words. ``content`` hashes the symbols from the first
    window's start to the last one's end together with the anchor's offset.
    """
    found: list[Segments] = []
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        for at in range(0, max(len(symbols) - window + 1, 0), BLOCK):
            part = symbols[at:at + BLOCK + window - 1]
            sums = prefix_sums(part)
            grams = len(part) - gram + 1
            key = mixed(hashes(sums, slice(0, grams), slice(gram, gram + grams)))
            packed = (key >> PLACE_BITS << PLACE_BITS) | np.arange(grams, dtype=np.uint64)
            place = (sliding_min(packed, window - gram + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            starts = np.arange(at, at + len(place))
            # windows that reach over the end of their sequence don't count
            inside = np.ones(len(place), bool)
            for e in ends[np.searchsorted(ends, at, "right"):np.searchsorted(ends, at + len(place) + window, "left")]:
                inside[max(0, e - at - window + 1):max(0, min(e - at, len(place)))] = False
            new = np.empty(len(place), bool)
            if not len(place):
                continue
            new[0] = True
            new[1:] = (place[1:] != place[:-1]) | (inside[1:] & ~inside[:-1])
            head = np.flatnonzero(new & inside)
            stop = np.append(np.flatnonzero(new | ~inside), len(place))
            tail = stop[np.searchsorted(stop, head, "right")] - 1
            anchor = place[head]
            content = mixed(hashes(sums, head, tail + window) ^ mixed((anchor - head).astype(np.uint64) + np.uint64(1)))
            content = mixed(content + (tail - head).astype(np.uint64))
            # smallest hashes crowd at zero: mixed again, they spread over the buckets
            found.append(Segments(starts[head], starts[tail], anchor + at, mixed(key[anchor]), content))
    if not found:
        none = np.empty(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Segments(*(np.concatenate([getattr(s, n) for s in found]) for n in ("first", "last", "place", "key", "content")))


def window_hashes(symbols: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Hashes of whole windows, block by block; ``starts`` in ascending order."""
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(symbols), BLOCK):
            lo, hi = np.searchsorted(starts, (at, at + BLOCK))
            if lo < hi:
                own = starts[lo:hi] - at
                out[lo:hi] = mixed(hashes(prefix_sums(symbols[at:at + BLOCK + window - 1]), own, own + window))
    return out
