"""Closest later places of paths, on grids as fine as the places are dense."""

from __future__ import annotations

import numpy as np

#: Later places in the nine cells around a place below which no finer grid is tried; the finest grid is the reach halved so often.
ENOUGH, FINEST = 16, 12
#: Pairs that are compared at once.
AT_ONCE = 1_000_000


class _Grid:
    """Places by cell, and in a cell by ``rank``: the rank of how far the path is."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, rank: np.ndarray, width: float):
        i, j = (np.floor(c / width).astype(np.int64) + 1 for c in (x, y))
        across = int(max(i.max(), j.max())) + 2
        self.keys, self.cell = np.unique((group * across + i) * across + j, return_inverse=True)
        self.n = len(rank) + 1
        at = self.cell * self.n + rank
        self.order = np.argsort(at)
        self.at = at[self.order]
        self.ends = np.searchsorted(self.at, np.arange(1, len(self.keys) + 1) * self.n)
        around = np.array([a * across + b for a in (-1, 0, 1) for b in (-1, 0, 1)])
        self.around = np.empty((len(self.keys), 9), np.int64)
        for s, step in enumerate(around):
            want = self.keys + step
            found = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            self.around[:, s] = np.where(self.keys[found] == want, found, -1)

    def later(self, asks: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``order`` the places of rank ``least`` or more begin, in each of the nine cells around, and how many they are."""
        cells = self.around[self.cell[asks]]
        first = np.searchsorted(self.at, cells * self.n + least[:, None])
        return first, np.where(cells >= 0, self.ends[cells] - first, 0)


def closest_later(group: np.ndarray, x: np.ndarray, y: np.ndarray, corner: tuple[np.ndarray, np.ndarray], way: np.ndarray, order: np.ndarray, asks: np.ndarray, reach: float, least_way: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The asks that have a later place of their group nearer than ``reach`` and ``least_way`` further on, the closest one, and its distance.

    ``asks`` are row numbers. Of equally close ones it is the first by ``order``. Grids begin at the ``corner`` of each
    row's group, which is near it and not beyond ``x`` or ``y``; within a group ``way`` rises with ``order``, strictly.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(asks):
        return none
    farthest = np.full(int(group.max()) + 1, -np.inf)
    np.maximum.at(farthest, group, way)
    asks = asks[farthest[group[asks]] - way[asks] >= least_way]
    if not len(asks):
        return none
    sorted_way = np.sort(way)
    rank = np.empty(len(way), np.int64)
    rank[np.argsort(way, kind="stable")] = np.arange(len(way))
    # A little too early: the rule itself is applied to the pairs.
    least = np.searchsorted(sorted_way, (way + least_way) * (1 - 1e-12))
    out = []

    # Equal places need no grid, and there may be very many of them.
    by = np.lexsort((rank, y, x, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by[1:]] != group[by[:-1]]) | (x[by[1:]] != x[by[:-1]]) | (y[by[1:]] != y[by[:-1]])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    at = place[by] * (len(by) + 1) + rank[by]
    spot = np.searchsorted(at, place[asks] * (len(by) + 1) + least[asks])
    for _ in range(2):  # the first found may lie short by a rounding
        there = by[np.minimum(spot, len(by) - 1)]
        same = (spot < len(by)) & (place[there] == place[asks])
        spot = np.where(same & (way[there] - way[asks] < least_way), spot + 1, spot)
    there = by[np.minimum(spot, len(by) - 1)]
    same = (spot < len(by)) & (place[there] == place[asks]) & (way[there] - way[asks] >= least_way)
    out.append((asks[same], there[same], np.zeros(int(same.sum()))))
    asks = asks[~same]

    # Cells are a trace wider than the reach, so that no rounding puts a nearer place two cells off.
    grid = lambda level: _Grid(group, x - corner[0], y - corner[1], rank, reach / 2**level * (1 + 1e-6))
    start, deep = np.full(len(asks), -1), np.arange(len(asks))
    for level in range(FINEST + 1):
        if not len(deep):
            break
        _, n = grid(level).later(asks[deep], least[asks[deep]])
        n = n.sum(axis=1)
        start[deep[n >= (1 if level == 0 else ENOUGH)]] = level
        deep = deep[n >= ENOUGH]
    left = np.empty(0, np.int64)
    for level in range(int(start.max(initial=-1)), -1, -1):
        now = np.concatenate([left, asks[start == level]])
        if not len(now):
            continue
        here, best, d = _closest(grid(level), now, least, x, y, way, order, reach / 2**level, least_way)
        out.append((here, best, d))
        left = np.setdiff1d(now, here, assume_unique=True)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _closest(grid: _Grid, asks: np.ndarray, least: np.ndarray, x: np.ndarray, y: np.ndarray, way: np.ndarray, order: np.ndarray, reach: float, least_way: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, n = grid.later(asks, least[asks])
    some = n.sum(axis=1) > 0
    asks, first, n = asks[some], first[some], n[some]
    upto = np.cumsum(n.sum(axis=1))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    begin = 0
    while begin < len(asks):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
        a, k = asks[begin:end], n[begin:end].ravel()
        at = np.repeat(first[begin:end].ravel() - np.cumsum(k) + k, k) + np.arange(k.sum())
        b = grid.order[at]
        each = n[begin:end].sum(axis=1)
        ref = np.repeat(a, each)
        starts = np.cumsum(each) - each
        dx, dy = x[b] - x[ref], y[b] - y[ref]
        d = np.sqrt(dx * dx + dy * dy)
        d[(way[b] - way[ref] < least_way) | (d >= reach)] = np.inf
        nearest = np.minimum.reduceat(d, starts)
        turn = np.where(d == np.repeat(nearest, each), order[b], np.iinfo(np.int64).max)
        chosen = np.flatnonzero(turn == np.repeat(np.minimum.reduceat(turn, starts), each))
        chosen = chosen[np.isfinite(d[chosen])]
        out.append((ref[chosen], b[chosen], d[chosen]))
        begin = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
