"""R-trees over count vectors, for set overlap.

A set's elements are hashed into groups; the group counts are a point. For two sets the summed minima of
their counts are at least their overlap, and so are the summed minima of one set's counts and a box's upper
corner for every point in the box. The bound is close while a group holds few elements, so larger sets have
more groups: their number is a power of two, and a point is compared with one of half as many groups by
adding its two halves.
"""

from __future__ import annotations

import numpy as np

LEAST_CELLS = 64
LEAF, FAN = 32, 8


def cells_for(size: int) -> int:
    """Groups of a set with so many elements: at most 8 elements to a group."""
    return max(LEAST_CELLS, 1 << (max(1, size) - 1 >> 3).bit_length())


def count_vector(hashes: np.ndarray) -> bytes:
    """Group counts of a set of hashes: a byte each, or more where a count needs it."""
    cells = cells_for(len(hashes))
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    top = counts.max(initial=0)
    return counts.astype(np.uint8 if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def folded(at: np.ndarray, cells: int) -> np.ndarray:
    """Points with fewer groups: group i gets the counts of all groups that are i modulo ``cells``."""
    return at if at.shape[1] == cells else at.reshape(len(at), -1, cells).sum(1, dtype=at.dtype)


def point(vector: bytes, size: int) -> np.ndarray:
    cells = cells_for(int(size))
    return np.frombuffer(vector, {1: np.uint8, 2: "<u2", 4: "<u4"}[len(vector) // cells]).astype(np.int32)


def points(vectors: list[bytes], cells: int) -> np.ndarray:
    """Points that all have ``cells`` groups."""
    if all(len(v) == cells for v in vectors):
        return np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, cells).astype(np.int32)
    kinds = {1: np.uint8, 2: "<u2", 4: "<u4"}
    return np.stack([np.frombuffer(v, kinds[len(v) // cells]).astype(np.int32) for v in vectors])


def needed(a, b, percent: int):
    """Least overlap of two sets of these sizes whose Jaccard index is ``percent`` / 100 or more."""
    return -(-percent * (a + b) // (100 + percent))


def near_in_size(a, b, percent: int):
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def pair_bound(v: bytes, n: int, w: bytes, m: int) -> int:
    """Upper bound of the overlap of two sets."""
    x, y = point(v, n), point(w, m)
    cells = min(len(x), len(y))
    return int(np.minimum(folded(x[None], cells), folded(y[None], cells)).sum())


class CountTree:
    """Bulk-loaded R-tree: points sorted by size and counts, ``LEAF`` to a leaf, and ``FAN`` boxes to a box of the level
    above, up to one root. A box holds the upper corner of its points and the range of their sizes."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*at[:, :4].T, sizes))
        self.at, self.sizes = at[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        upper, least, most, fan = self.at, self.sizes, self.sizes, LEAF
        while len(upper) > 1 or not self.levels:
            starts = np.arange(0, len(upper), fan)
            self.levels.append((np.r_[starts, len(upper)], np.maximum.reduceat(upper, starts, axis=0), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
            _, upper, least, most = self.levels[-1]
            fan = FAN

    def search(self, at: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that may overlap enough with ``at``, as places in the input, and their bounds."""
        live = np.zeros(1, np.int64)
        for starts, upper, least, most in reversed(self.levels):
            live = live[(100 * most[live] >= percent * size) & (100 * size >= percent * least[live])]
            live = live[np.minimum(upper[live], at).sum(1) >= needed(size, least[live], percent)]
            if not len(live):
                return live, live
            live = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in live])
        live = live[near_in_size(size, self.sizes[live], percent)]
        bound = np.minimum(self.at[live], at).sum(1)
        hit = bound >= needed(size, self.sizes[live], percent)
        return self.order[live[hit]], bound[hit]


class CountForest:
    """A tree for each number of groups; it also holds, folded, the sets with twice as many groups, since sets
    that are near in size differ by one step at most (``percent`` above 50)."""

    def __init__(self, vectors: list[bytes], sizes: np.ndarray):
        self.sizes, self.cells = sizes, np.array([cells_for(int(n)) for n in sizes])
        self.at: dict[int, np.ndarray] = {}
        self.row = np.zeros(len(sizes), np.int64)
        members = {int(c): np.flatnonzero(self.cells == c) for c in np.unique(self.cells)}
        for c, rows in members.items():
            self.at[c] = points([vectors[i] for i in rows], c)
            self.row[rows] = np.arange(len(rows))
        self.trees = {}
        for c, rows in members.items():
            above = members.get(2 * c, np.zeros(0, np.int64))
            at = np.concatenate([self.at[c], folded(self.at[2 * c], c)]) if len(above) else self.at[c]
            own = np.r_[rows, above]
            self.trees[c] = (CountTree(at, sizes[own]), own)

    def search(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Members that may reach the threshold with member ``i``, itself among them, and their bounds."""
        c, size = int(self.cells[i]), int(self.sizes[i])
        at = self.at[c][self.row[i]]
        tree, own = self.trees[c]
        found, bound = tree.search(at, size, percent)
        found = own[found]
        if c // 2 in self.trees:
            tree, own = self.trees[c // 2]
            less, b = tree.search(folded(at[None], c // 2)[0], size, percent)
            less = own[less]
            smaller = self.cells[less] == c // 2
            found, bound = np.r_[found, less[smaller]], np.r_[bound, b[smaller]]
        return found, bound
