"""A compressed full-text index over integer symbols, searched for many patterns in step."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with counts of the ones before each 64-bit word."""

    def __init__(self, flags: np.ndarray):
        words = -(-len(flags) // 64) + 1
        packed = np.zeros(words * 8, np.uint8)
        own = np.packbits(flags, bitorder="little")
        packed[:len(own)] = own
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    """Ranks of any symbol in a sequence; one bit vector a level, leading bits first."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels = max(1, int(count - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            flags = (symbols >> level) & 1 == 1
            self.bits.append(Bits(flags))
            self.zeros.append(int((~flags).sum()))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])
        every = np.arange(count)
        self.origin = np.zeros(count, np.int64)
        self.origin = self._place(every, np.zeros(count, np.int64))

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[i].rank(at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._place(symbol, at) - self.origin[symbol]


class FmIndex:
    """Index of strings over symbols 1, 2, ...; each string is indexed from its end to its start.

    Backward search then lengthens a match to the right, symbol by symbol.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, count: int):
        strings = len(sizes)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(strings), sizes)
        # reversed strings with a separator behind each, which sorts by its string's number
        total = len(symbols) + strings
        text = np.zeros(total, np.int64)
        spot = (ends - sizes)[owner] + ends[owner] - 1 - np.arange(len(symbols)) + owner
        text[spot] = symbols
        breaks = ends + np.arange(strings)
        rank = text + strings
        rank[breaks] = np.arange(strings)
        self.owner = np.empty(total, np.int64)  # string of each suffix in order
        width, longest = 1, int(sizes.max(initial=0)) + 1
        order = np.argsort(rank, kind="stable")
        while True:
            if width < longest:
                after = np.zeros(total, np.int64)
                after[:total - width] = rank[width:] + 1
                key = rank * np.int64(total + strings + count + 2) + after
                order = np.argsort(key, kind="stable")
                names = key[order]
                rank = np.empty(total, np.int64)
                rank[order] = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])])
                width *= 2
            else:
                break
        where = np.empty(total, np.int64)
        where[spot] = owner
        where[breaks] = np.arange(strings)
        self.owner = where[order]
        self.before = np.zeros(count + 2, np.int64)
        self.before[1:] = np.cumsum(np.bincount(text, minlength=count + 1))
        self.tree = WaveletTree(text[order - 1], count + 1)
        self.size = total

    def matches(
        self, symbols: np.ndarray, begins: np.ndarray, most: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the places ``begins`` of a stream: (length, low, high).

        The length of the longest match that starts at the place, counted up to ``most`` symbols,
        and the interval of suffixes that have it. Symbols the index lacks are 0.
        """
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), self.size)
        length = np.zeros(len(begins), np.int64)
        live, step = np.flatnonzero(most > 0), 0
        while len(live):
            symbol = symbols[begins[live] + step]
            new_low = self.before[symbol] + self.tree.rank(symbol, low[live])
            new_high = self.before[symbol] + self.tree.rank(symbol, high[live])
            found = (new_low < new_high) & (symbol > 0)
            live = live[found]
            low[live], high[live] = new_low[found], new_high[found]
            length[live] += 1
            step += 1
            live = live[most[live] > step]
        return length, low, high
