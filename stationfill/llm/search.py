"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to shards of a few megabytes of text. A shard's index has, for every term of
the questions, the documents that hold it and how often; terms that no question asks for are not
stored. Corpus statistics come from the stored index, so texts are tokenised once. A task then
turns each list of a shard into an impact list, highest impact first, and searches it for every
question:

* sorted access reads the next entries behind each list's best position;
* every document met is looked up in all other lists at once (direct access), which gives its
  whole score and marks its position in each list;
* a list's best position is the last one up to which all positions are marked. No unseen document
  can score more than the impacts at the best positions together: these move faster than what
  sorted access alone has read;
* the search stops as soon as that bound is strictly below the k-th best score, so ties are met.

A task keeps its k best across its shards, which lets later ones stop sooner, and the k best of all
tasks are merged in two steps. Questions are held by every task, ``MAX_QUESTION_WORDS`` at a time;
more are done in blocks. No result depends on the block or shard sizes.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. Null and
empty texts have none: such documents count for nothing, such questions have no result. Rows of
either table count one by one, whatever their ids; a null document id comes after all others.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import NO_ID, bounded_batches, text_of
from .contamination import words

BEST = 10
MAX_QUESTION_WORDS = 1_000_000
#: Bytes of text in a shard, and characters that are tokenised at a time.
SHARD_BYTES, PIECE = 16 << 20, 4 << 20
#: Entries of a list that the first sorted access reads; each further one reads twice as many.
FIRST_READ = 32
#: Parts that a question's results are dealt to in the first step of the merge.
SALTS = 32
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_INDEX = "n_docs long, n_words long, ids binary, lengths binary, terms array<int>, holders array<int>, docs binary, counts binary"


@dataclass
class Questions:
    """Items with their terms as numbers; equal terms of an item are counted."""

    terms: dict[bytes, int] = field(default_factory=dict)
    ids: list[int | None] = field(default_factory=list)
    items: list[tuple[list[int], list[int]]] = field(default_factory=list)
    n_words: int = 0

    def add(self, item_id: int | None, text: str | None) -> None:
        counted = Counter(words(text))
        self.ids.append(item_id)
        self.items.append(([self.terms.setdefault(t, len(self.terms)) for t in counted], list(counted.values())))
        self.n_words += sum(counted.values())


def question_blocks(items: DataFrame, most: int | None = None) -> Iterator[Questions]:
    """All items, in blocks of at most ``most`` words (or one item)."""
    most = MAX_QUESTION_WORDS if most is None else most
    block = Questions()
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if block.ids and block.n_words + len(words(row[1])) > most:
            yield block
            block = Questions()
        block.add(*row)
    yield block


def counted_words(text: str) -> Counter:
    """Terms of a text and how often it has them; a long text is taken in pieces that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        found.update(words(text[at:end]))
        at = end
    return found


def build_index(docs: DataFrame, questions: Questions) -> DataFrame:
    """A row per shard of documents: their ids and lengths, and a list of documents and counts per term asked for."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(questions.terms)
    limit = SHARD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        asked = terms.keys()
        ids: list[int] = []
        lengths: list[int] = []
        held = array("i"), array("i"), array("i")  # term, document, count
        size = 0

        def shard() -> pa.RecordBatch:
            keys = np.array(ids, np.int64)
            order = np.lexsort((keys, keys == NO_ID))
            place = np.empty(len(ids), np.int32)
            place[order] = np.arange(len(ids), dtype=np.int32)
            term, doc, count = (np.array(x, np.int32) for x in held)
            doc = place[doc]
            sort = np.lexsort((doc, term))
            term, doc, count = term[sort], doc[sort], count[sort]
            own, holders = np.unique(term, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([len(ids)], pa.int64()),
                    pa.array([sum(lengths)], pa.int64()),
                    pa.array([keys[order].astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.array(lengths, "<i8")[order].tobytes()], pa.binary()),
                    pa.array([own.tolist()], pa.list_(pa.int32())),
                    pa.array([holders.tolist()], pa.list_(pa.int32())),
                    pa.array([doc.astype("<i4").tobytes()], pa.binary()),
                    pa.array([count.astype("<i4").tobytes()], pa.binary()),
                ],
                ["n_docs", "n_words", "ids", "lengths", "terms", "holders", "docs", "counts"],
            )

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                counted = counted_words(text)
                if not counted:
                    continue
                common = counted.keys() & asked
                held[0].extend([terms[t] for t in common])
                held[1].extend([len(ids)] * len(common))
                held[2].extend([counted[t] for t in common])
                ids.append(i)
                lengths.append(counted.total())
                size += len(text)
                if size >= limit:
                    yield shard()
                    ids, lengths, held, size = [], [], (array("i"), array("i"), array("i")), 0
        if ids:
            yield shard()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of().alias("text"))
    return rows.mapInArrow(run, _INDEX)


@dataclass(frozen=True)
class ImpactList:
    """Documents that hold a term: by document (docs, impacts) and the place of each by falling impact."""

    docs: np.ndarray
    impacts: np.ndarray
    by_impact: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, docs: np.ndarray, counts: np.ndarray, norms: np.ndarray) -> ImpactList:
        impacts = 1_000_000_000 * counts // (1000 * counts + 8 * norms[docs])
        by_impact = np.argsort(-impacts, kind="stable")
        place = np.empty(len(docs), np.int64)
        place[by_impact] = np.arange(len(docs))
        return cls(docs, impacts, by_impact, place)


def best_positions(lists: list[ImpactList], weights: list[int], n_docs: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents met with their whole scores, and the entries read by sorted access.

    They include the k best (and what ties with the last of them) of all whose score is above
    zero and not below ``floor``, the k-th best score already known elsewhere.
    """
    seen = np.zeros(n_docs, bool)
    marked = [np.zeros(len(x.docs), bool) for x in lists]
    best = [0] * len(lists)  # so many first positions are marked
    met, scores, read, step = [], [], 0, FIRST_READ
    kth = floor
    while True:
        fresh = []
        for x, at in zip(lists, best):
            ahead = x.by_impact[at : at + step]
            read += len(ahead)
            fresh.append(x.docs[ahead])
        docs = np.unique(np.concatenate(fresh)) if fresh else np.zeros(0, np.int64)
        docs = docs[~seen[docs]]
        seen[docs] = True
        total = np.zeros(len(docs), np.int64)
        for x, mark, weight in zip(lists, marked, weights):
            at = np.searchsorted(x.docs, docs)
            held = at < len(x.docs)
            held[held] = x.docs[at[held]] == docs[held]
            mark[x.place[at[held]]] = True
            total[held] += weight * x.impacts[at[held]]
        met.append(docs)
        scores.append(total)
        bound, left = 0, False
        for i, (x, mark, weight) in enumerate(zip(lists, marked, weights)):
            rest = mark[best[i] :]
            best[i] += len(rest) if rest.all() else int(np.argmin(rest))
            if best[i] < len(mark):
                left = True
                bound += weight * int(x.impacts[x.by_impact[max(best[i] - 1, 0)]])
        every = np.concatenate(scores)
        if len(every) >= k:
            kth = max(floor, int(np.partition(every, -k)[-k]))
        if not left or bound < kth:
            return np.concatenate(met), every, read
        step *= 2


def search(index: DataFrame, questions: Questions, k: int = BEST) -> DataFrame:
    """item (number in ``questions``), doc_id, score and rank of each item's best documents."""
    spark = index.sparkSession
    whole = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n, length = whole[0] or 0, whole[1] or 0
    held = index.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy("x.terms").agg(F.sum("x.holders").alias("df"))
    # A row per term of the questions, which every task holds anyway.
    frequency = {r[0]: r[1] for r in held.collect()}
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in frequency.items()}
    items = [[(t, c * weight[t]) for t, c in zip(*x) if weight.get(t, 0) > 0] for x in questions.items]
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        kept: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                # Python's integers: the product may exceed 64 bits in a large corpus.
                norms = np.array([25 + 75 * x * n // length for x in np.frombuffer(row["lengths"], "<i8").tolist()], np.int64)
                docs = np.frombuffer(row["docs"], "<i4").astype(np.int64)
                counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
                lists, at = {}, 0
                for t, size in zip(row["terms"], row["holders"]):
                    lists[t] = ImpactList.of(docs[at : at + size], counts[at : at + size], norms)
                    at += size
                for i, asked in enumerate(items):
                    own = [(lists[t], w) for t, w in asked if t in lists]
                    if not own:
                        continue
                    before = kept.get(i, [])
                    floor = -before[-1][0] if len(before) == k else 0
                    met, scores, _ = best_positions([x for x, _ in own], [w for _, w in own], len(ids), k, floor)
                    some = np.flatnonzero(scores > 0)
                    # Documents of a shard are in the order of their ids.
                    some = some[np.lexsort((met[some], -scores[some]))][:k]
                    found = [(-s, d == NO_ID, d) for s, d in zip(scores[some].tolist(), ids[met[some]].tolist())]
                    kept[i] = sorted(before + found)[:k]
        rows = [(i, None if none else d, -s) for i, best in kept.items() for s, none, d in best]
        columns = zip(*rows) if rows else ([], [], [])
        types = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["item", "doc_id", "score"])

    found = index.mapInArrow(run, "item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents for every row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    blocks = []
    for questions in question_blocks(items):
        found = search(checkpointed(build_index(docs, questions)), questions, k)
        names = spark.createDataFrame(list(enumerate(questions.ids)), "item int, item_id long")
        blocks.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, blocks)
