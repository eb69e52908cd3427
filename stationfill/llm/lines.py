"""Incremental removal of lines that many documents share.

The exact state is a reference-count table: a row per (line key, document) with the number of
the document's lines with that key. Inserting documents adds rows and deleting them takes the
rows away again, so nothing that was done cannot be undone. From it follow the frequent keys:
how many documents hold a key, and the largest of them, which keeps its lines. Sharded cuckoo
filters of the frequent keys are kept beside it; keys that become frequent are added, keys that
cease to be are taken out. Documents' keys are screened by the filters, and only what passes
meets the exact counts, so a filter's false positives never drop a line.

A key is a 128-bit digest of the line without white space at its ends and with A-Z lowered.
Counts are combined before they are shuffled; documents of a frequent line are spread by
document first. Filters never pass through the driver: they meet references by shard.

Null and empty texts are one empty line. Rows with one id are one document, null ids are one,
smaller than all others. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import bounded_batches, keyed, release_memory
from .cuckoo import CuckooFilter, as_numbers

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
#: Frequent keys that one shard's filter is meant for.
SHARD_KEYS = 50_000
#: References of one shard that are tested in one group.
PART_ROWS = 50_000
#: Shards whose sizes are sent to all tasks, in some 16 MB; more of them are many enough to be joined.
MAX_SENT_SHARDS = 1 << 20
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str) -> bytes | None:
    """The digest of a line's key, None for keys that are too short to count."""
    line = line.strip(_BLANKS)
    if len(line) < MIN_LENGTH:
        return None
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest()


def references(docs: DataFrame) -> DataFrame:
    """The reference-count rows of some documents: key, __id, n."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, counts = [], [], []
            for key, text in zip(batch.column("__id").to_pylist(), batch.column("text")):
                own = Counter(map(line_key, text.as_py().split("\n")))
                own.pop(None, None)
                keys.extend(own)
                counts.extend(own.values())
                ids.extend([key] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["key", "__id", "n"])

    rows = keyed(docs).select("__id", "text").mapInArrow(run, "key binary, __id long, n long")
    return rows.groupBy("key", "__id").agg(F.sum("n").alias("n"))


def frequent_keys(refs: DataFrame) -> DataFrame:
    """key, n_docs and last (the largest document) of keys that enough documents hold."""
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("__id").alias("last"))
    return counts.where(F.col("n_docs") >= MIN_DOCUMENTS)


@dataclass(frozen=True)
class LineStore:
    """Reference counts, the frequent keys and their filters (shard, filter); ``shards`` is a power of two."""

    refs: DataFrame
    frequent: DataFrame
    filters: DataFrame
    shards: int

    def insert(self, docs: DataFrame) -> LineStore:
        """Add documents that are not in it."""
        refs = self.refs.unionByName(references(docs)).groupBy("key", "__id").agg(F.sum("n").alias("n"))
        return self._moved_to(checkpointed(refs))

    def delete(self, ids: DataFrame) -> LineStore:
        """Take out the documents whose id is in ``ids`` (column doc_id)."""
        return self._moved_to(checkpointed(self.refs.join(keyed(ids.withColumn("text", F.lit(""))).select("__id").distinct(), "__id", "left_anti")))

    def _moved_to(self, refs: DataFrame) -> LineStore:
        frequent = checkpointed(frequent_keys(refs))
        shards = shard_count(frequent)
        if shards != self.shards:
            return LineStore(refs, frequent, checkpointed(_built(frequent, shards)), shards)
        come = frequent.join(self.frequent, "key", "left_anti").select("key", F.lit(True).alias("come"))
        gone = self.frequent.join(frequent, "key", "left_anti").select("key", F.lit(False).alias("come"))
        moved = come.unionByName(gone).withColumn("shard", shard_of(shards))
        return LineStore(refs, frequent, checkpointed(_updated(self.filters, moved, frequent, shards)), shards)


def empty_store(docs: DataFrame) -> LineStore:
    refs = references(docs.limit(0))
    frequent = frequent_keys(refs)
    return LineStore(refs, frequent, _built(frequent, 1), 1)


def store_of(docs: DataFrame) -> LineStore:
    """The store of a first set of documents."""
    refs = checkpointed(references(docs))
    frequent = checkpointed(frequent_keys(refs))
    shards = shard_count(frequent)
    return LineStore(refs, frequent, checkpointed(_built(frequent, shards)), shards)


def shard_count(frequent: DataFrame) -> int:
    return 1 << max(0, (frequent.count() // SHARD_KEYS).bit_length())


def shard_of(shards: int):
    return (F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long") % shards).cast("int")


def _built(frequent: DataFrame, shards: int) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "filter": [CuckooFilter.of(sorted(rows["key"])).to_bytes()]})

    return frequent.select("key", shard_of(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _updated(filters: DataFrame, moved: DataFrame, frequent: DataFrame, shards: int) -> DataFrame:
    """Filters with keys added and removed; one that is too full is built anew from its keys."""

    def update(old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        if not len(old):
            return pd.DataFrame({"shard": change["shard"].iloc[:1], "filter": [CuckooFilter.of(sorted(change["key"][change["come"]])).to_bytes()]})
        now = CuckooFilter.from_bytes(old["filter"].iloc[0])
        for key in change["key"][~change["come"].astype(bool)]:
            now.remove(key)
        fits = all(now.add(key) for key in change["key"][change["come"].astype(bool)])
        return pd.DataFrame({"shard": old["shard"].iloc[:1], "filter": [now.to_bytes() if fits else None]})

    changed = checkpointed(filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, "shard int, filter binary"))
    full = changed.where("filter IS NULL").select("shard")
    again = frequent.withColumn("shard", shard_of(shards)).join(full, "shard", "left_semi").drop("shard")
    return changed.where("filter IS NOT NULL").unionByName(_built(again, shards))


def screened(refs: DataFrame, store: LineStore) -> DataFrame:
    """The rows of ``refs`` whose key may be frequent, by the filters alone.

    References meet their shard's filter on Spark. A shard's references are dealt to parts of
    about ``PART_ROWS``, by document, and each part gets a copy of the filter, so a line that a
    third of all documents have is not one task's work.
    """
    rows = refs.withColumn("shard", shard_of(store.shards))
    sizes = rows.groupBy("shard").agg((1 + F.floor(F.count(F.lit(1)) / PART_ROWS)).cast("int").alias("parts"))
    if store.shards <= MAX_SENT_SHARDS:
        # A row per shard: without it, few shards would bring all references to as few tasks just to be dealt out.
        sizes = F.broadcast(sizes)
    dealt = rows.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("__id", "key"), F.col("parts")).cast("int"))
    copies = store.filters.join(sizes, "shard").select("shard", "filter", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))

    def test(own: pa.Table, held: pa.Table) -> pa.Table:
        own = own.select(["key", "__id", "n"])
        if not own.num_rows or not held.num_rows:
            return own.slice(0, 0)
        keys = as_numbers(own.column("key").to_pylist())
        kept = own.filter(pa.array(CuckooFilter.from_bytes(held.column("filter")[0].as_py()).has(keys)))
        release_memory()
        return kept

    parts = dealt.select("key", "__id", "n", "shard", "part").groupBy("shard", "part")
    return parts.cogroup(copies.groupBy("shard", "part")).applyInArrow(test, "key binary, __id long, n long")


def dropped_keys(store: LineStore, refs: DataFrame | None = None) -> DataFrame:
    """Per document (__id) the keys whose lines it loses."""
    found = screened(store.refs if refs is None else refs, store).join(store.frequent, "key").where("__id <> last")
    return found.groupBy("__id").agg(F.collect_set("key").alias("keys"))


def cleaned(docs: DataFrame, store: LineStore) -> DataFrame:
    """Per row of ``docs``: doc_id, text without the lines it loses, n_lines and n_dropped."""
    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "__id", "text")
    joined = rows.join(dropped_keys(store), "__id", "left").select("doc_id", "text", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, lost = [], [], []
            for text, keys in zip(batch.column("text"), batch.column("keys")):
                text, keys = text.as_py(), keys.as_py()
                n.append(text.count("\n") + 1)
                if keys:
                    gone, all_lines = set(keys), text.split("\n")
                    kept = [x for x in all_lines if line_key(x) not in gone]
                    lost.append(len(all_lines) - len(kept))
                    text = "\n".join(kept)
                else:
                    lost.append(0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())],
                ["doc_id", "text", "n_lines", "n_dropped"],
            )

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_dropped long")


def digests(docs: DataFrame, store: LineStore | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256; by default with the store of the documents themselves."""
    return cleaned(docs, store or store_of(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
