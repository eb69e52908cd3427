"""Counting pairs of points within a distance in each coordinate, without listing or comparing them.

Points of two sides meet by group; within a group every point of side B lies on the far side of
every point of side A in the coordinates that are bounded. Then a pair is near in one coordinate
if B's value is at most A's and the distance: a prefix of B in the order of that coordinate. Two
such prefixes at once are counted with a merge tree, level by level, for all groups of a task
together: n log² n steps for n points, however many pairs there are.
"""

from __future__ import annotations

import numpy as np


def prefix_lengths(group_b: np.ndarray, b: np.ndarray, group_a: np.ndarray, a: np.ndarray, distance: float) -> np.ndarray:
    """For each a, where its group's b end that are at most ``distance`` away, as a place among all b.

    ``b`` is in the order of group and value, and b - a is not negative within a group.
    """
    groups = np.concatenate((group_b, group_a))
    values = np.concatenate((b, a + distance))
    is_a = np.concatenate((np.zeros(len(b), bool), np.ones(len(a), bool)))
    order = np.lexsort((is_a, values, groups))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(~is_a[order])
    end = place[len(b) :]
    first, last = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_b, group_a, "right")
    # a + distance is rounded; the rule itself is on b - a, so ends are moved by what it says.
    while True:
        more = end < last
        more[more] = b[end[more]] - a[more] <= distance
        less = ~more & (end > first)
        less[less] = b[end[less] - 1] - a[less] > distance
        if not (more.any() or less.any()):
            return end
        end = end + more - less


def weight_below(rank: np.ndarray, weight: np.ndarray, ends: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each query the weight of the first ``ends`` items whose rank is below ``limits``; ranks are 0 to n - 1, each once."""
    n = len(rank)
    total = np.zeros(len(ends), np.int64)
    for level in range(max(n, 1).bit_length()):
        asks = np.flatnonzero(ends >> level & 1)
        if not len(asks):
            continue
        # Blocks of 2^level items, sorted by rank inside: a query takes one of them whole where its end has this bit.
        block = np.arange(n) >> level
        order = np.lexsort((rank, block))
        keys = block[order] * (n + 1) + rank[order]
        upto = np.concatenate(([0], np.cumsum(weight[order])))
        taken = ((ends[asks] >> level) - 1).astype(np.int64)
        total[asks] += upto[np.searchsorted(keys, taken * (n + 1) + limits[asks])] - upto[taken << level]
    return total


def near_pairs(
    group_a: np.ndarray, a: np.ndarray, weight_a: np.ndarray, group_b: np.ndarray, b: np.ndarray, weight_b: np.ndarray, bounded: np.ndarray, distance: float
) -> int:
    """Sum over pairs of one group of the products of weights, where all bounded coordinates are within ``distance``.

    ``a`` and ``b`` have two columns. ``bounded`` says for each a which coordinates matter (the same
    within a group); at least one does.
    """
    order = np.lexsort((b[:, 0], group_b))
    group_b, b, weight_b = group_b[order], b[order], weight_b[order].astype(np.int64)
    first, last = np.searchsorted(group_b, group_a, "left"), np.searchsorted(group_b, group_a, "right")
    by_second = np.lexsort((b[:, 1], group_b))
    rank = np.empty(len(b), np.int64)
    rank[by_second] = np.arange(len(b))
    ends = np.where(bounded[:, 0], prefix_lengths(group_b, b[:, 0], group_a, a[:, 0], distance), last)
    limits = np.where(bounded[:, 1], prefix_lengths(group_b, b[by_second, 1], group_a, a[:, 1], distance), last)
    upto = np.concatenate(([0], np.cumsum(weight_b)))
    # Items of earlier groups come first in either order, and all of them are counted.
    found = weight_below(rank, weight_b, ends, limits) - upto[first]
    return int((found * weight_a.astype(np.int64)).sum())
