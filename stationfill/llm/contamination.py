"""Benchmark decontamination through a distributed positional inverted index.

Training texts are tokenised once. Documents are dealt to shards of a few megabytes, and for
each shard and each term of the test set the ordered positions of the term are stored: the
index has a row per (shard, term). Positions count through a shard with a gap between
documents, so a list needs no document ids. Corpus frequencies come from the lengths of all
lists. A phrase is looked up from its rarest term: the list is shifted by the term's place in
the phrase and cut down by the next rarest term's shifted list, and so on until it is empty or
the whole phrase has matched. Proximity asks that a test item's rarest terms occur within a
span of words.

The index grows with the corpus and is stored by a checkpoint; a shard's lists are at most as
large as its texts' words. The test set is held by every task: at most ``MAX_TEST_WORDS``
words at a time, a larger one is done in blocks of items.

Null texts have no words, neither do empty ones, and such documents and items match nothing.
Rows equal in id and text get equal results, a row each. Items with a null id are left out. The smallest 64-bit number stands for a null id
inside, so a document with that id comes out with a null one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import NO_ID, bounded_batches, keyed, rows_without, text_of

WINDOW = 13
#: Words of one block of the test set that tasks hold at a time.
MAX_TEST_WORDS = 250_000
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Rarest terms of an item that proximity asks for, and the span they must lie in.
NEAR_TERMS, NEAR_SPAN = 3, 13

#: Bytes as words see them: A-Z lowered, other ASCII that is no digit or letter a blank.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


@dataclass(frozen=True)
class TestSet:
    """Items as lists of term numbers; ``ids`` are their ids as strings."""

    ids: tuple[str, ...]
    items: tuple[np.ndarray, ...]
    terms: dict[bytes, int]


def test_blocks(benchmark: DataFrame, max_words: int = MAX_TEST_WORDS) -> Iterator[TestSet]:
    """The test set in blocks of bounded size, items streamed one after the other."""
    ids, items, terms, total = [], [], {}, 0
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("i"), text_of().alias("t"))
    for row in rows.toLocalIterator():
        found = words(row["t"])
        if not found:
            continue
        if items and total + len(found) > max_words:
            yield TestSet(tuple(ids), tuple(items), terms)
            ids, items, terms, total = [], [], {}, 0
        items.append(np.array([terms.setdefault(w, len(terms)) for w in found]))
        ids.append(row["i"])
        total += len(found)
    # An empty test set is a block too: documents have their words counted all the same.
    yield TestSet(tuple(ids), tuple(items), terms)


def positional_index(docs: DataFrame, test: TestSet) -> DataFrame:
    """Rows (shard, term, positions) for terms of the test set, and per shard one with term -1.

    That row lists where each document begins; ``keys`` and ``hashes`` have the documents' keys
    in order. The last begin is the end of the shard. ``docs`` has __id, __th and text.
    """
    bounded_batches(docs.sparkSession)
    terms = docs.sparkSession.sparkContext.broadcast(test.terms)

    def shards(batches: Iterator[pa.RecordBatch]):
        keys, hashes, found, size = [], [], [], 0
        for batch in batches:
            for key, th, text in zip(batch.column("__id").to_pylist(), batch.column("__th").to_pylist(), batch.column("text")):
                text = text.as_py()
                keys.append(key)
                hashes.append(th)
                found.append(words(text))
                size += len(text)
                if size >= SHARD_BYTES:
                    yield keys, hashes, found
                    keys, hashes, found, size = [], [], [], 0
        if keys:
            yield keys, hashes, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_of = terms.value.get
        part = TaskContext.get().partitionId() << 20
        for keys, hashes, found in shards(batches):
            # A shard is named by its task and what it holds, so a task that runs again names it alike.
            shard = hashlib.blake2b(repr((keys, hashes)).encode(), digest_size=12).hexdigest()
            part += 1
            starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in found])))
            number = np.fromiter((term_of(w, -1) for x in found for w in (*x, b"")), np.int64, int(starts[-1]))
            place = np.flatnonzero(number >= 0)
            place = place[np.argsort(number[place], kind="stable")]
            names, first = np.unique(number[place], return_index=True)
            lists = np.split(place, first[1:]) if len(names) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * (len(names) + 1)),
                    pa.array([part] * (len(names) + 1), pa.int64()),
                    pa.array([-1, *names.tolist()], pa.int32()),
                    pa.array([starts.astype("<i8").tobytes(), *(x.astype("<i8" if starts[-1] >= 2**31 else "<i4").tobytes() for x in lists)], pa.binary()),
                    pa.array([len(keys), *(len(x) for x in lists)], pa.int64()),
                    pa.array([np.array(keys, "<i8").tobytes(), *[None] * len(names)], pa.binary()),
                    pa.array([np.array(hashes, "<i8").tobytes(), *[None] * len(names)], pa.binary()),
                ],
                ["shard", "part", "term", "positions", "n", "keys", "hashes"],
            )

    return docs.select("__id", "__th", "text").mapInArrow(
        run, "shard string, part long, term int, positions binary, n long, keys binary, hashes binary"
    )


def _phrase(lists: dict[int, np.ndarray], phrase: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Starts of a phrase, from its rarest term on."""
    starts = None
    for at in order:
        own = lists.get(phrase[at])
        if own is None:
            return _NONE
        if starts is None:
            starts = own - at
            continue
        found = np.searchsorted(own, starts + at)
        found[found == len(own)] = 0
        starts = starts[own[found] == starts + at]
        if not len(starts):
            return _NONE
    return starts


_NONE = np.zeros(0, np.int64)


def _near(lists: dict[int, np.ndarray], terms: np.ndarray, span: int, starts: np.ndarray) -> np.ndarray:
    """Positions of the rarest term that lie within ``span`` words of one document together with all other ``terms``.

    Of every other term only the nearest to the left and to the right can help, if they are in the
    same document (one begins at each of ``starts``); each way to take sides is tried.
    """
    at = lists.get(terms[0], _NONE)
    after = np.searchsorted(starts, at, side="right")
    begin, end = starts[after - 1], starts[np.minimum(after, len(starts) - 1)]
    gaps = []
    for term in terms[1:]:
        own = lists.get(term, _NONE)
        if not len(own) or not len(at):
            return _NONE
        after = np.searchsorted(own, at)
        before, behind = own[np.maximum(after - 1, 0)], own[np.minimum(after, len(own) - 1)]
        left = np.where((after > 0) & (before >= begin), at - before, span)
        right = np.where((after < len(own)) & (behind < end), behind - at, span)
        gaps.append((left, right))
    near = np.zeros(len(at), bool)
    for sides in product((0, 1), repeat=len(gaps)):
        reach = [np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
        for side, gap in zip(sides, gaps):
            reach[side] = np.maximum(reach[side], gap[side])
        near |= reach[0] + reach[1] < span
    return at[near]


def matches(index: DataFrame, test: TestSet, near: bool = True) -> DataFrame:
    """Per document: __id, __th, n_words, hits (its hit words), items and near_items (places in ``test.ids``)."""
    spark = index.sparkSession
    counted = index.where("term >= 0").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(test.terms), np.int64)
    frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    phrases = []
    for i, item in enumerate(test.items):
        n = min(WINDOW, len(item))
        for first in range(len(item) - n + 1):
            phrase = item[first : first + n]
            phrases.append((i, phrase, np.argsort(frequency[phrase], kind="stable")))
    names = list(test.terms)
    by_name = np.empty(len(names), np.int64)
    by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    rarest = []
    for item in test.items:
        rare = np.unique(item)
        # Of equally rare terms the smaller ones, so the choice does not hang on the order items are read in.
        rarest.append(rare[np.lexsort((by_name[rare], frequency[rare]))][:NEAR_TERMS])
    shared = spark.sparkContext.broadcast((phrases, rarest, test.ids))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        phrases, rarest, ids = shared.value
        head = rows[rows["term"] < 0].iloc[0]
        starts = np.frombuffer(head["positions"], "<i8")
        width = "<i8" if starts[-1] >= 2**31 else "<i4"
        lists = {t: np.frombuffer(p, width).astype(np.int64) for t, p in zip(rows["term"], rows["positions"]) if t >= 0}
        edges = np.zeros(int(starts[-1]) + 1, np.int32)
        hit: dict[int, set[int]] = {}
        close: dict[int, set[int]] = {}

        def note(into: dict[int, set[int]], at: np.ndarray, i: int) -> None:
            for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                into.setdefault(d, set()).add(i)

        for i, phrase, order in phrases:
            found = _phrase(lists, phrase, order)
            if len(found):
                np.add.at(edges, found, 1)
                np.add.at(edges, found + len(phrase), -1)
                note(hit, found, i)
        for i, rare in enumerate(rarest if near else ()):
            note(close, _near(lists, rare, NEAR_SPAN, starts), i)
        covered = np.cumsum(edges) > 0
        keys, hashes = np.frombuffer(head["keys"], "<i8"), np.frombuffer(head["hashes"], "<i8")
        docs = range(len(keys))
        return pd.DataFrame(
            {
                "__id": keys,
                "__th": hashes,
                "n_words": np.diff(starts) - 1,
                "hits": [np.flatnonzero(covered[starts[d] : starts[d + 1]]).tolist() if d in hit else [] for d in docs],
                "items": [sorted(ids[i] for i in hit.get(d, ())) for d in docs],
                "near_items": [sorted(ids[i] for i in close.get(d, ())) for d in docs],
            }
        )

    return index.groupBy("shard", "part").applyInPandas(
        run, "__id long, __th long, n_words long, hits array<int>, items array<string>, near_items array<string>"
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, near: bool = True) -> DataFrame:
    """Per row of ``docs``: __id, __th, n_words, n_hit, items, near_items (item ids as sorted strings)."""
    rows = keyed(docs)
    blocks = []
    for test in test_blocks(benchmark):
        found = matches(checkpointed(positional_index(rows, test)), test, near)
        blocks.append(
            found.select("__id", "__th", "n_words", "hits", "items", "near_items", F.lit(len(blocks)).alias("__block"))
        )
    if len(blocks) == 1:
        return blocks[0].withColumn("n_hit", F.size("hits").cast("long"))
    every = reduce(DataFrame.unionByName, blocks)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")]
    merged = every.groupBy("__id", "__th", "n_words").agg(*lists, F.count_if(F.col("__block") == 0).alias("__copies"))
    return merged.withColumns(
        {"n_hit": F.size("hits").cast("long"), "__copy": F.explode(F.expr("sequence(1, __copies)"))}
    )


def contaminated():
    """The rule: at least a twentieth of the words, and one at least, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digests(docs: DataFrame, benchmark: DataFrame, near: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``near`` also n_near_items, near_items_sha256."""
    close = (F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256"))
    return overlaps(docs, benchmark, near).select(
        F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        *(close if near else ()),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that the rule clears, all columns. Only contaminated keys, few of all, take part in the join."""
    bad = overlaps(docs, benchmark, near=False).where(contaminated()).select("__id", "__th").distinct()
    return rows_without(docs, bad)
