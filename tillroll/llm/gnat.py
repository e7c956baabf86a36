"""Geometric near-neighbour access tree over a few integer points, for many queries at once.

A node has up to ``DEGREE`` split points; every other point goes to its nearest split point, and each
pair (split point, child) stores the range of distances from the one to the points of the other.
A query that lies d from a split point with a best distance of r so far can skip a child whose
range does not meet [d - r, d + r]. Distances are roots, so ranges are widened and d is bracketed by
whole numbers; children are skipped only where the gap is strict, and points are compared by
exact squared distances, ties to the lower index. So the tree never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np

DEGREE = 4
LEAF = 3   # so few points are compared without split points


def _squares(queries: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = queries - point
    return np.einsum("ij,ij->i", gap, gap)


def _root_below(squares: np.ndarray) -> np.ndarray:
    """A whole number not above the root, less than two below it."""
    return np.maximum(np.floor(np.sqrt(squares.astype(np.float64)) * (1 - 1e-15)).astype(np.int64) - 1, 0)


def _root_above(squares: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + 1e-15)).astype(np.int64) + 1


@dataclass
class Node:
    splits: list[int]             # indexes of points; in a leaf all of them
    children: list[Node | None]   # by split point
    least: list[list[int]]        # least[i][j]: distance from split i to the nearest point of child j, rounded down
    most: list[list[int]]         # to the farthest, rounded up


def build(points: np.ndarray, members: list[int] | None = None) -> Node:
    """The tree of ``points``; split points are spread out, each the farthest from those before it."""
    members = list(range(len(points))) if members is None else members
    if len(members) <= max(LEAF, 1):
        return Node(members, [None] * len(members), [], [])
    splits, nearest = [members[0]], {m: _exact(points[m], points[members[0]]) for m in members}
    while len(splits) < min(DEGREE, len(members)):
        far = max(members, key=lambda m: (nearest[m], -m))
        if nearest[far] == 0:
            break                 # only copies of split points are left
        splits.append(far)
        nearest = {m: min(d, _exact(points[m], points[far])) for m, d in nearest.items()}
    groups: list[list[int]] = [[] for _ in splits]
    for m in members:
        if m not in splits:
            gaps = [_exact(points[m], points[s]) for s in splits]
            groups[gaps.index(min(gaps))].append(m)
    least, most = [], []
    for s in splits:
        gaps = [[_exact(points[s], points[m]) for m in g] or [0] for g in groups]
        least.append([isqrt(min(g)) for g in gaps])
        most.append([isqrt(max(g)) + 1 for g in gaps])
    return Node(splits, [build(points, g) if g else None for g in groups], least, most)


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))


def nearest(tree: Node, points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each query's nearest point, ties to the lower index, and the distances taken."""
    index = np.full(len(queries), len(points), np.int64)
    square = np.full(len(queries), np.iinfo(np.int64).max, np.int64)
    return index, square, _search(tree, points, queries, np.arange(len(queries)), index, square)


def _search(node: Node, points: np.ndarray, queries: np.ndarray, rows: np.ndarray, index: np.ndarray,
            square: np.ndarray) -> int:
    """Lowers ``index`` and ``square`` of ``rows`` by the points of ``node``; the number of distances taken."""
    mine = queries[rows]
    gaps = []
    for p in node.splits:
        gap = _squares(mine, points[p])
        best = square[rows]
        better = (gap < best) | ((gap == best) & (p < index[rows]))
        square[rows[better]], index[rows[better]] = gap[better], p
        gaps.append(gap)
    taken = len(rows) * len(node.splits)
    if not any(c is not None for c in node.children):
        return taken
    low, high = [_root_below(g) for g in gaps], [_root_above(g) for g in gaps]
    # a query's own split point first: what it finds there skips most of the rest
    own = np.argmin(np.stack(gaps), axis=0)
    for first in (True, False):
        for j, child in enumerate(node.children):
            if child is None:
                continue
            at = np.flatnonzero((own == j) == first)
            radius = _root_above(square[rows[at]])
            meets = np.ones(len(at), bool)
            for i in range(len(node.splits)):
                meets &= (low[i][at] - radius <= node.most[i][j]) & (high[i][at] + radius >= node.least[i][j])
            at = at[meets]
            if len(at):
                taken += _search(child, points, queries, rows[at], index, square)
    return taken
