"""Words of packed texts as arrays: runs of bytes between ASCII white space."""

from __future__ import annotations

import numpy as np

from .anchors import hashes, mixed, prefix_sums

#: Words hashed at a time.
GROUP = 40_000


def word_borders(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of each word, and how many words each text has."""
    solid = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    ends = np.cumsum(sizes)
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    stop = np.append(False, solid)
    stop[:-1] &= ~solid
    inner = ends[(ends > 0) & (ends < len(data))]
    start[inner] |= solid[inner]
    stop[inner] |= solid[inner - 1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop)
    counts = np.diff(np.searchsorted(begin, ends, "left"), prepend=0)
    return begin, end, counts


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(begin), GROUP):
            b, e = begin[at:at + GROUP], end[at:at + GROUP]
            sums = prefix_sums(data[b[0]:e[-1]])
            out[at:at + GROUP] = mixed(hashes(sums, b - b[0], e - b[0]) + (e - b).astype(np.uint64))
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only
