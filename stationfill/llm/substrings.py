"""Removal of repeated 50-byte strings by sorting the suffixes that can repeat.

Only suffixes at anchors are sorted. An anchor is where the 16 bytes that follow have the least
hash of some 50-byte window; equal windows have their anchors at equal places, so a string that
occurs twice has an anchor in common. The work is a chain of shuffles:

1. Documents are dealt to shards of a few megabytes. A shard tells, in 32 bits each, which
   anchors it has.
2. By range of hash it is found which anchors more than one document has; shards are told.
3. For those, shards send what is around the anchor, as far as windows go whose first least hash
   it has: 34 bytes before at most, 50 from it on, once for equal surroundings, with the smallest id.
4. By range of hash these are sorted, by what follows and, reversed, by what precedes: multikey
   quicksort to a shallow depth, then blind tries. Neighbours' common lengths tell which windows over an
   anchor agree, and the smallest document of each; shards are told where it is not their own.
5. Shards cover, in each document, the windows that a smaller document has.

Hashes only bring together what may be equal; anchors agree if their bytes do. There are as many
ranges of hash as the text needs, so what a task holds does not grow with the corpus.

An anchor that very many documents have, such as at the edges of a popular passage where everything
around it differs, is not brought to one place: its windows are dealt out one by one instead, by
digest, which meets no more rows for a window than there are shards. That sends some nine times the
bytes, so it is left to anchors that are too many for a task.

Documents go through one exchange that all steps read. Rows with a null id come before all others,
rows with equal ids do not remove each other's strings. Null and empty texts have no bytes.
An empty table gives an empty one. ``__th`` orders rows of one id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fan_out
from .common import NO_ID, keyed, release_memory
from .suffixes import common_prefixes, sorted_order

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM  # bytes that a window may begin before its anchor
#: Bytes of text in a shard, and for each range of hash.
SHARD_BYTES, RANGE_BYTES = 2 << 20, 2 << 20
#: Documents that may have an anchor before its windows are dealt out one by one: what a task holds of one hash.
WIDE = 1 << 15

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _extremes(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _hash(*words: np.ndarray) -> np.ndarray:
    """Hashes of bytes given as numbers of eight each; never 0, which stands for no anchor."""
    h = np.zeros(len(words[0]), np.uint64)
    for i, word in enumerate(words):
        h = (h ^ (word + np.uint64(i + 1)) * _MIX[1]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


class Shard:
    """The documents of a shard laid end to end, and their anchors."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["__id", "__th"], kind="stable")  # the same whenever it is made
        texts = [t.encode() for t in rows["text"]]
        self.rows, self.ids = rows, rows["__id"].to_numpy(np.int64)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.starts = self.ends - [len(t) for t in texts]
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.at, self.hash, self.left, self.right = self._anchors()
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of anchors, and how far their own windows go to the left and to the right of them.

        A window is its first least hash's own, so it is told of at one anchor, and equal windows at equal ones.
        """
        n, none = len(self.data), np.zeros(0, np.int64)
        if n < LENGTH:
            return none, np.zeros(0, np.uint64), none, none
        words = np.ndarray(n - 7, "<u8", np.ascontiguousarray(self.data), strides=(1,))
        h = _hash(*(words[8 * i : n - GRAM + 1 + 8 * i] for i in range(GRAM // 8)))
        least = _extremes(h, REACH + 1, np.minimum)
        # Windows that reach beyond their document count for nothing.
        whole = np.zeros(n + 1, np.int32)
        long = self.ends - self.starts >= LENGTH
        np.add.at(whole, self.starts[long], 1)
        np.add.at(whole, self.ends[long] - LENGTH + 1, -1)
        least = np.where(np.cumsum(whole)[: len(least)] > 0, least, np.uint64(0))
        edge = np.zeros(REACH, np.uint64)
        most = _extremes(np.concatenate((edge, least, edge)), REACH + 1, np.maximum)
        at = np.flatnonzero(most[: len(h)] == h)
        # Windows in a row with one least hash have one anchor, as a rule.
        start = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        end = np.append(start[1:], len(least)) - 1
        some = least[start] > 0
        start, end = start[some], end[some]

        def owners(window: np.ndarray) -> np.ndarray:
            """The first place in each window that has its least hash; all such places are anchors."""
            owner = np.searchsorted(at, window)
            late = np.flatnonzero(h[at[owner]] != least[window])
            while len(late):
                owner[late] += 1
                late = late[h[at[owner[late]]] != least[window[late]]]
            return owner

        owner = owners(start)
        several = end > at[owner]  # the hash is there again, in windows that begin after its first place
        if several.any():
            size = (end - start + 1)[several]
            window = np.repeat(start[several] - np.cumsum(size) + size, size) + np.arange(size.sum())
            own = owners(window)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            last = np.append(first[1:], len(window)) - 1
            start, end = np.append(start[~several], window[first]), np.append(end[~several], window[last])
            owner = np.append(owner[~several], own[first])
            order = np.argsort(start)
            start, end, owner = start[order], end[order], owner[order]
        at = at[owner]
        return at, h[at], at - start, end + LENGTH - at

    def around(self, which: np.ndarray) -> np.ndarray:
        """Bytes around anchors, REACH before and LENGTH from there on; zero outside of the document."""
        offsets = np.arange(-REACH, LENGTH)
        place = np.clip(self.at[which][:, None] + offsets, 0, len(self.data) - 1)
        inside = (offsets >= -self.left[which][:, None]) & (offsets < self.right[which][:, None])
        return np.where(inside, self.data[place], 0).astype(np.uint8)

    def records(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors with a hash in ``shared``, the number of each one's surroundings, and an anchor for each number.

        Surroundings are numbered by hash first. Anchors come in the order of documents, so the one
        named for a number is in its smallest document.
        """
        which = np.flatnonzero(np.isin(self.hash, shared))
        if not len(which):
            return which, which, which
        ends = np.stack((self.left[which], self.right[which]), axis=1).astype(np.uint8)
        key = np.concatenate((self.hash[which].astype(">u8").view(np.uint8).reshape(-1, 8), self.around(which), ends), axis=1)
        key = np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel()
        _, first, number = np.unique(key, return_index=True, return_inverse=True)
        return which, number, which[first]

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows over anchors with a hash in ``shared``: start, document, number by digest, and the digests in order."""
        which = np.flatnonzero(np.isin(self.hash, shared))
        first, last = self.at[which] - self.left[which], self.at[which] - LENGTH + self.right[which]
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)] or [np.zeros(0, np.int64)]))
        digests = [hashlib.blake2b(self.data[p : p + LENGTH].tobytes(), digest_size=16).digest() for p in starts]
        distinct, number = np.unique(np.array(digests, "V16"), return_inverse=True) if len(digests) else (np.zeros(0, "V16"), np.zeros(0, np.int64))
        return starts, np.searchsorted(self.ends, starts, side="right"), number, distinct


def _split(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted 64-bit keys by their first bits, and where each begins; ends with the number of keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    names, first = np.unique(bucket, return_index=True)
    return names, np.append(first, len(keys))


def _short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


_TOLD = "shard int, bucket int, narrow binary, wide binary"
_SENT = "bucket int, shard int, wide boolean, n int, packed binary"
_BACK = "shard int, bucket int, wide boolean, number binary, low binary, high binary, first binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, compressed: text that is shuffled by hash compresses little in Spark's own blocks."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in arrays))


def _unpacked(rows: pd.DataFrame, kinds: tuple) -> list[np.ndarray]:
    """The arrays packed in each row, joined over the rows; ``kinds`` has type and items per record of each."""
    unpack, parts = zstandard.ZstdDecompressor(), [[] for _ in kinds]
    for n, data in zip(rows["n"], rows["packed"]):
        data, at = unpack.decompress(data), 0
        for part, (kind, width) in zip(parts, kinds):
            size = n * width * np.dtype(kind).itemsize
            part.append(np.frombuffer(data[at : at + size], kind))
            at += size
    return [np.concatenate(x) for x in parts]


def _told(told: pd.DataFrame, shard: Shard, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the shard's hashes, those said to be shared: few enough shards, and too many."""
    hashes = np.unique(shard.hash)
    names, first = _split(hashes, bits)
    own = {b: hashes[i:j] for b, i, j in zip(names.tolist(), first, first[1:])}
    out: list[list[np.ndarray]] = [[], []]
    for b, narrow, wide in zip(told["bucket"], told["narrow"], told["wide"]):
        for k, said in enumerate((narrow, wide)):
            out[k].append(own[b][np.isin(_short(own[b], bits), np.frombuffer(said, "<u4"))])
    narrow, wide = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)
    return narrow, wide


def _numbered(grams: np.ndarray) -> np.ndarray:
    """A number for every different row of bytes: anchors of one hash are told apart by what they are."""
    words = np.ascontiguousarray(grams).view("<u8")
    order = np.lexsort(words.T)
    number = np.zeros(len(words), np.int64)
    number[order[1:]] = np.cumsum((words[order[1:]] != words[order[:-1]]).any(axis=1))
    return number


def _agreement(h: np.ndarray, around: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray):
    """For each record, all different, and run of window offsets, the smallest document of equal windows.

    Gives records, lowest and highest offset and first: windows begin that many bytes before the anchor.
    """
    sides = []
    for data in (around[:, REACH + GRAM :], np.ascontiguousarray(around[:, :REACH][:, ::-1])):
        order = sorted_order(h, data)
        shared = common_prefixes(h, data, order)
        sides.append((order, shared))
    def runs(side: int, need: int) -> np.ndarray:
        order, shared = sides[side]
        run = np.empty(len(h), np.int64)
        run[order] = np.cumsum(shared < need)
        return run

    # Most anchors have the same around them wherever they occur: all of their windows agree.
    whole = ((runs(0, LENGTH - GRAM) * (len(h) + 1) + runs(1, REACH)) * (LENGTH + 1) + right) * (REACH + 1) + left
    order = np.argsort(h)
    starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    sizes = np.diff(np.append(starts, len(h)))
    alike = np.minimum.reduceat(whole[order], starts) == np.maximum.reduceat(whole[order], starts)
    pure = np.empty(len(h), bool)
    pure[order] = np.repeat(alike, sizes)
    lowest = np.empty(len(h), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[order], starts), sizes)
    low, high = np.maximum(LENGTH - right, 0), left
    plain = np.flatnonzero(pure & (low <= high))
    found = [(plain, low[plain], high[plain], lowest[plain])]

    # For the others, each place of a window over the anchor is looked at.
    mixed = np.flatnonzero(~pure)
    none = np.iinfo(np.int64).max
    before, since = np.full(len(mixed), none), np.zeros(len(mixed), np.int64)
    for back in range(REACH + 2):
        now = np.full(len(mixed), none)
        if back <= REACH:
            fits = np.flatnonzero((left[mixed] >= back) & (right[mixed] >= LENGTH - back))
            rows = mixed[fits]
            if len(rows):
                key = runs(0, LENGTH - back - GRAM)[rows] * (len(h) + 1) + runs(1, back)[rows]
                by = np.argsort(key)
                starts = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
                lowest = np.minimum.reduceat(least[rows[by]], starts)
                first = np.empty(len(rows), np.int64)
                first[by] = np.repeat(lowest, np.diff(np.append(starts, len(by))))
                now[fits] = first
        change = np.flatnonzero(now != before)
        over = change[before[change] != none]
        found.append((mixed[over], since[over], np.full(len(over), back - 1), before[over]))
        since[change] = back
        before = now
    return [np.concatenate(x) for x in zip(*found)]


def repeated(docs: DataFrame, shard_bytes: int = SHARD_BYTES, wide: int = WIDE) -> DataFrame:
    """Per row of ``docs``: doc_id, text_bytes (what is left), n_bytes, n_removed, n_spans."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(fan_out(spark), -(-total // shard_bytes))
    bits = max(4, (total // RANGE_BYTES).bit_length(), (2 * fan_out(spark) - 1).bit_length())
    rows = keyed(docs).select(
        F.pmod(F.xxhash64("__id", "__th", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
        "__id", "__th", "text",
    )

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows)
        order = np.lexsort((shard.doc, shard.hash))
        sorted_hash, sorted_doc = shard.hash[order], shard.doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
        hashes, n = np.unique(sorted_hash[new], return_counts=True)
        names, first = _split(hashes, bits)
        return pd.DataFrame(
            {
                "bucket": names,
                "shard": int(rows["shard"].iloc[0]),
                "hashes": [_short(hashes[i:j], bits).tobytes() for i, j in zip(first, first[1:])],
                "documents": [np.minimum(n[i:j], 255).astype("u1").tobytes() for i, j in zip(first, first[1:])],
            }
        )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, "<u4") for x in rows["hashes"]]
        documents = np.concatenate([np.frombuffer(x, "u1") for x in rows["documents"]])
        found, where = np.unique(np.concatenate(lists), return_inverse=True)
        n = np.bincount(where, documents, len(found))
        is_wide, is_shared = n > wide, n > 1
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        chosen = lambda flag: [x[f].tobytes() for x, f in zip(lists, np.split(flag[where], cuts))]
        return pd.DataFrame(
            {"shard": rows["shard"], "bucket": rows["bucket"], "narrow": chosen(is_shared & ~is_wide), "wide": chosen(is_wide)}
        )

    def send(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            shard = Shard(rows)
            narrow, broad = _told(told, shard, bits)
            _, _, named = shard.records(narrow)
            names, first = _split(shard.hash[named], bits) if len(named) else ([], [])
            for b, i, j in zip(names, first, first[1:]):
                own = named[i:j]
                out.append(
                    (b, False, len(own), _pack(shard.around(own), shard.left[own].astype("u1"), shard.right[own].astype("u1"), shard.ids[shard.doc[own]]))
                )
            _, doc, number, distinct = shard.windows(broad)
            if len(distinct):
                least = np.full(len(distinct), np.iinfo(np.int64).max)
                np.minimum.at(least, number, shard.ids[doc])
                lead = np.frombuffer(distinct.tobytes(), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
                names, first = _split(lead, bits)
                out += [(b, True, j - i, _pack(distinct[i:j], least[i:j])) for b, i, j in zip(names, first, first[1:])]
            del shard
        release_memory()
        made = pd.DataFrame(out, columns=["bucket", "wide", "n", "packed"])
        return made.assign(shard=int(rows["shard"].iloc[0]) if len(rows) else 0)[[x.split()[0] for x in _SENT.split(", ")]]

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", kind="stable").reset_index(drop=True)
        sizes = rows["n"].to_numpy(np.int64)
        of_row, number = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.arange(n) for n in sizes])
        if rows["wide"].iloc[0]:
            keys, least = _unpacked(rows, (("V16", 1), (np.int64, 1)))
            _, group = np.unique(keys, return_inverse=True)
            first = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, group, least)
            which = np.flatnonzero(first[group] < least)
            low = high = np.zeros(len(which), np.int64)
            first = first[group[which]]
        else:
            around, left, right, least = _unpacked(rows, ((np.uint8, REACH + LENGTH), (np.uint8, 1), (np.uint8, 1), (np.int64, 1)))
            around, left, right = around.reshape(-1, REACH + LENGTH), left.astype(np.int64), right.astype(np.int64)
            alike = np.concatenate((around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)), axis=1)
            _, one, group = np.unique(np.ascontiguousarray(alike).view(f"V{alike.shape[1]}").ravel(), return_index=True, return_inverse=True)
            lowest = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(lowest, group, least)
            told = _agreement(_numbered(around[one][:, REACH : REACH + GRAM]), around[one], left[one], right[one], lowest)
            # Back to the shards that sent them, wherever a smaller document than their own was found.
            members = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[members], np.arange(len(one) + 1))
            size = ends[told[0] + 1] - ends[told[0]]
            which = members[np.repeat(ends[told[0]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            low, high, first = (np.repeat(x, size) for x in told[1:])
            use = first < least[which]
            which, low, high, first = which[use], low[use], high[use], first[use]
        order = np.argsort(of_row[which], kind="stable")
        which, low, high, first = which[order], low[order], high[order], first[order]
        cuts = np.searchsorted(of_row[which], np.arange(len(rows) + 1))
        out = [
            (rows["shard"][r], rows["bucket"][r], rows["wide"][r], number[which[i:j]].astype("<u4").tobytes(), low[i:j].astype("u1").tobytes(),
             high[i:j].astype("u1").tobytes(), first[i:j].astype("<i8").tobytes())
            for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i
        ]
        release_memory()
        return pd.DataFrame(out, columns=[x.split()[0] for x in _BACK.split(", ")])

    def cover(rows: pd.DataFrame, told: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows)
        narrow, broad = _told(told, shard, bits)
        edges = np.zeros(len(shard.data) + 1, np.int64)

        def mark(start: np.ndarray, end: np.ndarray) -> None:
            np.add.at(edges, start, 1)
            np.add.at(edges, end, -1)

        which, number, named = shard.records(narrow)
        if len(which):
            at, doc, left, right = (x[which] for x in (shard.at, shard.ids[shard.doc], shard.left, shard.right))
            own = shard.ids[shard.doc[named]][number] < doc
            own &= left + right >= LENGTH
            mark(at[own] - left[own], at[own] + right[own])
            _, first = _split(shard.hash[named], bits)
            names, _ = _split(shard.hash[named], bits)
            begin = dict(zip(names.tolist(), first))
            by_number = np.argsort(number, kind="stable")
            cuts = np.searchsorted(number[by_number], np.arange(len(named) + 1))
            said = back[~back["wide"].astype(bool)]
            for b, numbers, low, high, firsts in zip(said["bucket"], said["number"], said["low"], said["high"], said["first"]):
                k = np.frombuffer(numbers, "<u4").astype(np.int64) + begin[b]
                size = cuts[k + 1] - cuts[k]
                rows_of = by_number[np.repeat(cuts[k] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                low, high, firsts = (np.repeat(np.frombuffer(x, t), size).astype(np.int64) for x, t in ((low, "u1"), (high, "u1"), (firsts, "<i8")))
                use = firsts < doc[rows_of]
                mark(at[rows_of][use] - high[use], at[rows_of][use] - low[use] + LENGTH)
        starts, doc, number, distinct = shard.windows(broad)
        if len(distinct):
            least = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least, number, shard.ids[doc])
            lead = np.frombuffer(distinct.tobytes(), ">u8").reshape(-1, 2)[:, 0].astype(np.uint64)
            names, first = _split(lead, bits)
            begin = dict(zip(names.tolist(), first))
            said = back[back["wide"].astype(bool)]
            for b, numbers, firsts in zip(said["bucket"], said["number"], said["first"]):
                k = np.frombuffer(numbers, "<u4").astype(np.int64) + begin[b]
                least[k] = np.minimum(least[k], np.frombuffer(firsts, "<i8"))
            use = least[number] < shard.ids[doc]
            mark(starts[use], starts[use] + LENGTH)
        gone = np.cumsum(edges)[:-1] > 0
        enters = gone & ~np.append(False, gone[:-1])[: len(gone)]
        # A removed run that touches the next document's is a run of its own there.
        heads = shard.starts[(shard.starts < shard.ends)]
        enters[heads] = gone[heads]
        total, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(enters))
        kept = [shard.data[i:j][~gone[i:j]].tobytes() for i, j in zip(shard.starts, shard.ends)]
        return pd.DataFrame(
            {
                "__id": shard.ids,
                "text_bytes": kept,
                "n_bytes": shard.ends - shard.starts,
                "n_removed": total[shard.ends] - total[shard.starts],
                "n_spans": runs[shard.ends] - runs[shard.starts],
            }
        )

    by_shard = lambda df: df.groupBy("shard")
    have = by_shard(rows).applyInPandas(tell, "bucket int, shard int, hashes binary, documents binary")
    told = have.groupBy("bucket").applyInPandas(compare, _TOLD)
    sent = by_shard(rows).cogroup(by_shard(told)).applyInPandas(send, _SENT)
    back = sent.groupBy("bucket", "wide").applyInPandas(sort, _BACK)
    # Both answers reach the last step in one table, since two tables can be grouped together and no more.
    answers = told.select(
        "shard", "bucket", "narrow", F.col("wide").alias("broad"), *[F.lit(None).cast(t).alias(c) for c, t in (("wide", "boolean"), ("number", "binary"), ("low", "binary"), ("high", "binary"), ("first", "binary"))]
    ).unionByName(back.select("shard", "bucket", *[F.lit(None).cast("binary").alias(c) for c in ("narrow", "broad")], "wide", "number", "low", "high", "first"))

    def finish(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["__id", "text_bytes", "n_bytes", "n_removed", "n_spans"])
        is_told = answers["wide"].isna()
        return cover(rows, answers[is_told][["bucket", "narrow"]].assign(wide=answers["broad"][is_told]), answers[~is_told])

    done = by_shard(rows).cogroup(by_shard(answers)).applyInPandas(finish, "__id long, text_bytes binary, n_bytes long, n_removed long, n_spans long")
    return done.select(F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id"), "text_bytes", "n_bytes", "n_removed", "n_spans")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text_bytes", 256).alias("kept_sha256"))
