"""Texts that share most of their word shingles with others, found by exact counts.

A text can be similar to another at 0.8 only if four fifths of its distinct shingles occur in
other texts. How often each shingle occurs is counted exactly, in two shuffles:

1. Tasks read texts in chunks of half a million shingles. The distinct shingles of a chunk, with
   their counts in it, go to buckets by range of hash; what tells them apart is packed as differences
   of sorted numbers. A shingle that a third of all texts have is one entry per chunk.
2. A bucket adds the counts and answers every chunk, in the chunk's own order. The answers meet
   the chunk's list of texts, and texts with more than a fifth of shingles of their own go.

Buckets are as many as the shingles need, so a group stays at a few megabytes at any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release_memory
from .simhash import SEED

WIDTH = 5
#: Shingles of a chunk (or one text), and how many of the corpus a bucket gets, by length of text.
CHUNK, BUCKET_CHARS = 1 << 19, 8 << 20
#: Bits of a shingle's hash.
BITS = 56
#: One odd factor per place in a shingle.
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, repeats included; at least one."""
    import xxhash

    words = text.encode().lower().split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = min(width, len(words))
    total = np.full(max(len(words) - n, 0) + 1, n, np.uint64)
    for i in range(n):
        total += hashes[i : len(words) - n + 1 + i] * _FACTORS[i]
    # Sums alone keep patterns of the factors; this spreads every bit.
    total ^= total >> np.uint64(32)
    total *= _FACTORS[-1]
    total ^= total >> np.uint64(29)
    return total


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingles of a text, by the upper bits of their hashes."""
    return np.unique(shingle_hashes(text, width) >> np.uint64(64 - BITS))


def _fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _packed(*arrays: np.ndarray) -> bytes:
    import zstandard

    # Byte planes: the upper bytes of small numbers are zeros next to each other.
    planes = [(x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, 5))


def _unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    out = []
    for kind, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel())
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32)


_PARTS = "place long, chunk long, part int, data binary"
#: Words of 64 bits in the parity map of a set.
MAP_WORDS = 4
_TEXTS = "node binary, n int, fp long, own binary, firsts array<long>, alone int, " + ", ".join(f"map{i} long" for i in range(MAP_WORDS))


def _chunks(rows: DataFrame, width: int, buckets: int) -> DataFrame:
    limit = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, nodes, prints, sets, size = context.partitionId() << 32, {}, [], [], 0

        def parts() -> pa.RecordBatch:
            each = np.array([len(x) for x in sets])
            doc = np.repeat(np.arange(len(sets)), each)
            every = np.concatenate(sets)
            order = np.argsort(every, kind="stable")
            found, counts = np.unique(every[order], return_counts=True)
            cuts = np.searchsorted(found, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(-(-(1 << BITS) // buckets)))
            names = np.frombuffer(b"".join(nodes), "V16")
            out = [(chunk, -1, _packed(names, each, np.array(prints, np.int64), _small(doc[order]), _small(counts)))]
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[b], cuts[b + 1])
                out.append((b, b, _packed(np.diff(found[own], prepend=np.uint64(0)), _small(counts[own]))))
            place, part, data = zip(*out)
            columns = [pa.array(place, pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["place", "chunk", "part", "data"])

        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                if node in nodes:  # equal texts are one
                    continue
                nodes[node] = None
                hashes = shingle_hashes(text.as_py(), width)
                prints.append(_fingerprint(hashes))
                sets.append(np.unique(hashes >> np.uint64(64 - BITS)))
                size += len(sets[-1])
                if size >= limit:
                    yield parts()
                    release_memory()
                    chunk, nodes, prints, sets, size = chunk + 1, {}, [], [], 0
        if sets:
            yield parts()

    return rows.select("node", "text").mapInArrow(run, _PARTS)


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's answers: for each chunk the total of each of its shingles, and those that are in several texts."""
    lists = rows["part"] >= 0
    kept, asked = rows[~lists], rows[lists]
    if not len(asked):
        return kept
    parts = [_unpacked(x) for x in asked["data"]]
    hashes = [np.cumsum(d, dtype=np.uint64) for d, _ in parts]
    _, where = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
    totals = np.split(np.minimum(total, (1 << 32) - 1)[where], np.cumsum([len(x) for x in hashes])[:-1])
    answers = [_packed(_small(t), np.diff(h[t > 1], prepend=np.uint64(0))) for t, h in zip(totals, hashes)]
    del parts, hashes, where, total, totals
    release_memory()
    return pd.concat([kept, asked.assign(place=asked["chunk"], data=answers)])


def parity_map(hashes: np.ndarray) -> np.ndarray:
    """A bit per slot of a hash: whether an odd number of the set's hashes fall in it.

    Two sets whose maps differ in k bits differ in k elements at least.
    """
    odd = np.bincount((hashes % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sharers(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a chunk's texts those with at most a fifth of shingles of their own."""
    rows = rows.sort_values("part")
    nodes, sizes, prints, doc, counts = _unpacked(rows["data"].iloc[0])
    answers = [_unpacked(x) for x in rows["data"].iloc[1:]]
    total = np.concatenate([t.astype(np.int64) for t, _ in answers])
    shared = np.concatenate([np.cumsum(h, dtype=np.uint64) for _, h in answers])
    value = np.zeros(len(total), np.uint64)
    value[total > 1] = shared
    each = np.repeat(np.arange(len(total)), counts)
    several = np.flatnonzero(total[each] > 1)
    alone = sizes - np.bincount(doc[several], minlength=len(nodes))
    fits = 5 * alone <= sizes
    several = several[fits[doc[several]]]
    h, t, d = value[each[several]], total[each[several]], doc[several].astype(np.int64)
    by_hash, by_total = np.lexsort((h, d)), np.lexsort((h, t, d))
    cuts = np.searchsorted(d[by_hash], np.arange(len(nodes) + 1))
    out = []
    for i in np.flatnonzero(fits).tolist():
        own = slice(cuts[i], cuts[i + 1])
        first = h[by_total[own]][: sizes[i] // 5 + 1 - alone[i]]
        shared = h[by_hash[own]]
        out.append((nodes[i].tobytes(), sizes[i], prints[i], shared.tobytes(), first.astype(np.int64), alone[i], *parity_map(shared).tolist()))
    release_memory()
    return pd.DataFrame(out, columns=[x.split()[0] for x in _TEXTS.split(", ")])


def sharers(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Texts (node, 16 bytes that name it, and text) of whose shingles at least four fifths occur in other texts; equal texts may come twice.

    ``n`` distinct shingles, ``alone`` of them nowhere else; ``own`` the others, sorted; ``firsts``
    of them the rarest, as many as prefix filtering needs at 0.8; ``fp`` the SimHash; ``map0``, … the
    parity map of ``own``.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-chars // BUCKET_CHARS))
    counted = _chunks(rows, width, buckets).groupBy("place").applyInPandas(_count, _PARTS)
    return counted.groupBy("chunk").applyInPandas(_sharers, _TEXTS)
