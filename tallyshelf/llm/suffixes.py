"""Suffix arrays by grouping: Lyndon-prefix groups from the largest down, then one pass that emits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of all suffixes in order. Linear; nothing is renamed or sorted recursively.

    Suffixes begin in groups by first symbol. Groups are taken from the largest down. For each suffix
    of a group the pointer to the nearest earlier suffix of a smaller group is set, over the pointers
    set before; a suffix that is pointed at moves to a new group right behind its own, further behind
    the more suffixes of the group point at it. In the end a group holds the suffixes that share
    their longest Lyndon prefix, and inside a group the order is that of what follows the prefix.
    That is the order in which those followers come out, so one pass from the smallest suffix up
    fills all groups from their fronts.
    """
    n = len(symbols)
    group: list[int] = [0] * n
    members: list[list[int]] = []
    by_symbol: dict[int, int] = {}
    for value in sorted(set(symbols)):
        by_symbol[value] = len(members)
        members.append([])
    for i, value in enumerate(symbols):
        g = by_symbol[value]
        group[i] = g
        members[g].append(i)
    below = list(range(-1, len(members) - 1))  # neighbours in the order of groups
    above = [*range(1, len(members)), -1]

    smaller = [-1] * n  # nearest earlier suffix in a smaller group
    done = [False] * n
    size = [len(m) for m in members]
    finished: list[list[int]] = []

    def move(found: list[int], old: int, under: int) -> int:
        """A new group of ``found``, taken out of ``old``, right behind the group ``under``."""
        new, over = len(members), above[under]
        members.append(found)
        size.append(len(found))
        size[old] -= len(found)
        below.append(under)
        above.append(over)
        above[under] = new
        if over >= 0:
            below[over] = new
        for p in found:
            group[p] = new
        return new

    g = len(members) - 1
    while g >= 0:
        if size[g] == 1:
            own = members[g]
            i = own[0] if len(own) == 1 else next(i for i in own if group[i] == g)
            done[i] = True
            p = i - 1
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            finished.append([i])
            if p >= 0 and size[group[p]] > 1:  # a group of one stays as it is
                move([p], group[p], group[p])
        elif size[g]:
            own = members[g]
            if len(own) != size[g]:
                own = [i for i in own if group[i] == g]
            own.sort()
            for i in own:
                done[i] = True
            hits: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            finished.append(own)
            moved: dict[tuple[int, int], list[int]] = {}
            for p, count in hits.items():
                moved.setdefault((group[p], count), []).append(p)
            last: dict[int, int] = {}
            for old, count in sorted(moved) if len(moved) > 1 else moved:
                found = moved[old, count]
                if size[old] != len(found) or old in last:
                    last[old] = move(found, old, last.get(old, old))
        members[g] = ()
        g = below[g]

    # where each group begins; its front moves on as its suffixes come out
    front, total = [0] * len(members), 0
    for own in reversed(finished):
        front[group[own[0]]] = total
        total += len(own)
    order, placed = [-1] * n, [False] * n
    follower = n  # the empty suffix is the smallest
    for at in range(-1, n):
        if at >= 0:
            follower = order[at]
        p = follower - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[front[g]] = p
            front[g] += 1
            placed[p] = True
            p = smaller[p]
    return order


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix in order shares with the one before it, counted up to ``most``."""
    padded = np.concatenate([symbols, np.full(most + 1, -1, symbols.dtype)])
    out = np.zeros(len(order), np.int64)
    rows = np.arange(1, len(order))
    for depth in range(most):
        left, right = padded[order[rows] + depth], padded[order[rows - 1] + depth]
        rows = rows[(left == right) & (left >= 0)]
        if not len(rows):
            break
        out[rows] += 1
    return out
