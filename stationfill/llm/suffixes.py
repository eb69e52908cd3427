"""Ordering many short byte strings that share long beginnings: deep-shallow sorting.

A multikey quicksort on words of eight bytes orders strings to a shallow depth: what is below,
at and above a pivot word is parted three ways, and the middle goes on with the next word. Groups
that still agree there, and do not agree to the end, are ordered by a blind trie each: a string
goes down by the branching bytes alone, is compared in full with one leaf, and is inserted where
it first differs.
"""

from __future__ import annotations

import numpy as np

#: Words of eight bytes that are sorted before tries take over.
SHALLOW = 2
#: Strings that are few enough to be sorted at once, the usual end of a quicksort.
FEW = 2048


class BlindTrie:
    """A trie that keeps branching positions only; ``order`` walks its leaves."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [None]
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        text = self.strings[i]
        if self.root[0] is None:
            self.root[0] = ([i], None, None)
            return
        node = self.root[0]
        while node[1] is not None:  # blind: bytes between branching positions are not looked at
            node = node[2].get(text[node[1]]) or next(iter(node[2].values()))
        other = self.strings[node[0][0]]
        at = next((k for k, (a, b) in enumerate(zip(text, other)) if a != b), len(text))
        if at == len(text):
            node[0].append(i)
            return
        kept, key = self.root, 0
        node = kept[key]
        while node[1] is not None and node[1] < at:
            kept, key = node[2], text[node[1]]
            node = kept[key]
        leaf = ([i], None, None)
        if node[1] == at:
            node[2][text[at]] = leaf
        else:
            kept[key] = ([], at, {text[at]: leaf, other[at]: node})

    def order(self) -> list[int]:
        out, open_nodes = [], [self.root[0]] if self.root[0] else []
        while open_nodes:
            leaves, at, kids = open_nodes.pop()
            if at is None:
                out.extend(leaves)
            else:
                open_nodes.extend(kids[b] for b in sorted(kids, reverse=True))
        return out


def multikey_quicksort(keys: np.ndarray, few: int = FEW) -> np.ndarray:
    """The order of the rows of ``keys``, word by word."""
    order, depth = np.arange(len(keys)), keys.shape[1]
    parts = [(0, len(keys), 0)]
    while parts:
        lo, hi, at = parts.pop()
        rows = order[lo:hi]
        if hi - lo <= few:
            order[lo:hi] = rows[np.lexsort(keys[rows, at:].T[::-1])] if at < depth else rows
            continue
        words = keys[rows, at]
        sample = np.sort(words[:: max((hi - lo) // 9, 1)])
        pivot = sample[len(sample) // 2]
        below, above = words < pivot, words > pivot
        middle = ~(below | above)
        order[lo:hi] = np.concatenate((rows[below], rows[middle], rows[above]))
        first, second = lo + int(below.sum()), hi - int(above.sum())
        parts += [part for part in ((lo, first, at), (second, hi, at)) if part[1] - part[0] > 1]
        if at + 1 < depth and second - first > 1:
            parts.append((first, second, at + 1))
    return order


def sorted_order(groups: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The order of rows of ``data`` (bytes, one length) by group and content."""
    n, width = data.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = data
    words = padded.view(">u8").astype(np.uint64)
    shallow = np.column_stack((groups.astype(np.uint64), words[:, :SHALLOW]))
    order = multikey_quicksort(shallow)
    new = np.ones(n, bool)
    new[1:] = (shallow[order[1:]] != shallow[order[:-1]]).any(axis=1)
    deep = words[:, SHALLOW:]
    # Neighbours that differ below the shallow depth mark the groups that need a trie.
    differs = np.zeros(n, bool)
    differs[1:] = ~new[1:] & (deep[order[1:]] != deep[order[:-1]]).any(axis=1)
    starts = np.append(np.flatnonzero(new), n)
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(differs), side="right") - 1):
        rows = order[starts[k] : starts[k + 1]]
        same: dict[bytes, list[int]] = {}
        for i, x in enumerate(padded[rows, 8 * SHALLOW :]):
            same.setdefault(x.tobytes(), []).append(i)
        strings = list(same)
        order[starts[k] : starts[k + 1]] = rows[[i for x in BlindTrie(strings).order() for i in same[strings[x]]]]
    return order


def common_prefixes(groups: np.ndarray, data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row and the one before it in ``order``; -1 across groups."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 1 << 16):
        a, b = order[at : at + (1 << 16)], order[at - 1 : at - 1 + (1 << 16)][: len(order[at : at + (1 << 16)])]
        unlike = data[a] != data[b]
        length = np.where(unlike.any(axis=1), unlike.argmax(axis=1), data.shape[1])
        out[at : at + len(a)] = np.where(groups[a] == groups[b], length, -1)
    return out
