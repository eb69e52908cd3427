"""A cuckoo filter over digests: membership with few false positives and none missed, with deletion."""

from __future__ import annotations

import numpy as np

_SLOTS = 4
_KICKS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """16-bit tags in buckets of four; a tag may be in either of two buckets, each known from the other and the tag.

    Keys are digests of at least 16 bytes. The same key may be added once only; what was added may be removed.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (_SLOTS * 0.85)))))
        return cls(np.zeros((buckets, _SLOTS), "<u2"))

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter of all keys, doubled in size until they fit."""
        n = len(keys)
        while True:
            made = cls.for_keys(n)
            if all(made.add(k) for k in keys):
                return made
            n *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag and both buckets of keys given as rows of two 64-bit numbers."""
        tag = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        tag[tag == 0] = 1
        first = keys[:, 1] >> np.uint64(16) & np.uint64(len(self.table) - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket, tag):
        return bucket ^ ((np.asarray(tag).astype(np.uint64) * _MIX) >> np.uint64(20) & np.uint64(len(self.table) - 1))

    def add(self, key: bytes) -> bool:
        """False if no place was found; the filter has then lost a tag and has to be made anew, larger."""
        tag, first, second = (x[0] for x in self._places(as_numbers([key])))
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = tag
                return True
        bucket = first
        for kick in range(_KICKS):
            slot = (int(tag) + kick) % _SLOTS
            tag, self.table[bucket, slot] = self.table[bucket, slot], tag
            bucket = self._other(bucket, tag)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = tag
                return True
        return False

    def remove(self, key: bytes) -> bool:
        """Take out a key that was added; False if it is not there."""
        tag, first, second = (x[0] for x in self._places(as_numbers([key])))
        for bucket in (first, second):
            found = np.flatnonzero(self.table[bucket] == tag)
            if len(found):
                self.table[bucket, found[0]] = 0
                return True
        return False

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys, rows of two 64-bit numbers, may be in it."""
        tag, first, second = self._places(keys)
        tag = tag[:, None]
        return (self.table[first] == tag).any(axis=1) | (self.table[second] == tag).any(axis=1)


def as_numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:16] for k in keys), "<u8").reshape(-1, 2)
