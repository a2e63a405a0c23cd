"""An R-tree over count vectors, searched for sets that may overlap enough."""

from __future__ import annotations

import numpy as np

FAN, LEAF = 8, 16
#: The least number of groups.
LEAST = 16


def groups_for(size: int) -> int:
    """Groups for a set of ``size`` elements: the power of two above, so that few elements share one."""
    return max(LEAST, 1 << int(size).bit_length())


def count_vector(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Elements of each group; the group is the last bits of the hash, so halves fold together."""
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def packed(vector: np.ndarray) -> bytes:
    return vector.astype(np.uint8 if vector.max(initial=0) < 256 else np.int32).tobytes()


def unpacked(blob: bytes, size: int) -> np.ndarray:
    """The vector of a set of ``size`` elements."""
    kind = np.uint8 if len(blob) == groups_for(size) else np.int32
    return np.frombuffer(blob, kind).astype(np.int32)


def pair_bounds(vectors: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The most that the sets of each pair can overlap, as far as their counts tell."""
    out = np.empty(len(left), np.int64)
    groups = np.array([len(v) for v in vectors])
    fewer = np.minimum(groups[left], groups[right])
    for g in np.unique(fewer):
        rows = np.flatnonzero(fewer == g)
        own, place = np.unique(np.concatenate([left[rows], right[rows]]), return_inverse=True)
        points = np.stack([folded(vectors[k], int(g)) for k in own.tolist()])
        a, b = place[:len(rows)], place[len(rows):]
        step = max(1, (1 << 21) // int(g))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            out[rows[part]] = np.minimum(points[a[part]], points[b[part]]).sum(1)
    return out


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(0, dtype=np.int32)


def needed(left, right, percent: int):
    """The least overlap of sets of these sizes with a Jaccard similarity of ``percent``."""
    return -(-(left + right) * percent // (100 + percent))


class CountTree:
    """Points of equal length, packed by halving along the coordinate that spreads most.

    A box keeps the largest count of each coordinate and the least set size below it. The overlap of
    a set with any set in the box is at most the sum of the smaller of its counts and the box's.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order: list[np.ndarray] = []

        def pack(rows: np.ndarray) -> None:
            if len(rows) <= LEAF:
                order.append(rows)
                return
            part = points[rows]
            axis = int(part.var(0).argmax())
            ranked = rows[np.lexsort((sizes[rows], part[:, axis]))]
            half = len(rows) // 2
            pack(ranked[:half])
            pack(ranked[half:])

        pack(np.arange(len(points)))
        self.leaves = order
        top = np.stack([points[r].max(0) for r in order])
        least = np.array([sizes[r].min() for r in order])
        self.levels = [(top, least)]
        while len(top) > FAN:
            heads = np.arange(0, len(top), FAN)
            top, least = np.maximum.reduceat(top, heads, axis=0), np.minimum.reduceat(least, heads)
            self.levels.append((top, least))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bound on the overlap reaches what the similarity needs."""
        rows = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            bound = np.minimum(top[rows], point).sum(1)
            rows = rows[bound >= needed(size, np.maximum(least[rows], -(-size * percent // 100)), percent)]
            if depth:
                rows = (rows[:, None] * FAN + np.arange(FAN)).ravel()
                rows = rows[rows < len(self.levels[depth - 1][0])]
        if not len(rows):
            return rows
        found = np.concatenate([self.leaves[r] for r in rows.tolist()])
        bound = np.minimum(self.points[found], point).sum(1)
        return np.sort(found[bound >= needed(size, self.sizes[found], percent)])


def trees(vectors: list[np.ndarray], sizes: np.ndarray) -> dict[int, tuple[CountTree, np.ndarray]]:
    """For each number of groups, a tree of the vectors that have it or twice as many, and their rows."""
    own = np.array([len(v) for v in vectors])
    out = {}
    for groups in np.unique(own):
        rows = np.flatnonzero((own == groups) | (own == 2 * groups))
        points = np.stack([folded(vectors[r], int(groups)) for r in rows.tolist()])
        out[int(groups)] = CountTree(points, sizes[rows]), rows
    return out


def candidates(vectors: list[np.ndarray], sizes: np.ndarray, percent: int):
    """(row, later rows that may be similar enough) of every row.

    A partner has at least ``percent`` of a set's size, hence as many groups, half or twice as many.
    """
    forest = trees(vectors, sizes)
    for i, vector in enumerate(vectors):
        found = []
        for groups in (len(vector), len(vector) // 2):
            if groups in forest:
                tree, rows = forest[groups]
                near = rows[tree.search(folded(vector, groups), int(sizes[i]), percent)]
                if groups < len(vector):  # twice as many groups met in the first tree
                    near = near[[len(vectors[r]) == groups for r in near.tolist()]]
                found.append(near)
        near = np.concatenate(found) if found else np.empty(0, np.int64)
        yield i, np.unique(near[near != i])
