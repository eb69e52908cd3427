"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Each segment has a table of the
fingerprints by the segment's value. Of two that differ in at most two bits, one segment differs
in one bit at most: so the Hamming ball of radius one around each segment, 33 values, is looked up in
its table, and complete distances of what is found are compared.

Where many near copies share a segment, its value is crowded. Both sides of a crowded value are split
by the other segment: they are entered under its ball of radius one as well, where two that are two
bits apart meet halfway. Nothing is lost, and what meets agrees in all but three of 64 bits.

Equal fingerprints are one row from the start. Null text is empty; texts without words have
fingerprint zero and are linked like any other. Ids may be null or repeated: the smallest
present id names the component (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import bounded_batches, keyed, rows_of
from .components import connected_components

SEED = 42
MAX_DISTANCE = 2
#: Fingerprints with one value of a segment from which on they are split by the other segment; no result depends on it.
CROWD = 64
_CHUNK = 1 << 16


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of a text, repeats included; of fewer words, all of them; of none, nothing."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprint(text: str, width: int = 3) -> int:
    """The signed 64-bit SimHash: a bit is 1 if it is set in over half the shingle hashes."""
    import xxhash

    parts = shingles(text, width)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(parts), _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in parts[i : i + _CHUNK]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row: doc_id, __id, __th and fp, from the whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x.as_py(), width) for x in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "__id", "__th")), fp], ["doc_id", "__id", "__th", "fp"])

    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "__id", "__th", "text")
    return rows.mapInArrow(run, "doc_id long, __id long, __th long, fp long")


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v), u < v, between different values of ``fp`` that differ in at most two bits, each of them once.

    Spark takes what ``explode`` gives for as large as what it was given, 66 or 1,089 times too small: without a word
    it would send such a table to every task through the driver. So exploded sides always meet by a sort merge join.
    """
    spread = F.expr("transform(sequence(0, 31), b -> shiftleft(1L, b))")
    ball = F.concat(F.array(F.lit(0).cast("long")), spread)
    # A segment's table: number and value of the segment in one key, and the other segment.
    low, high = F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)")
    second = F.lit(1 << 32)
    both = F.array(F.struct(low.alias("key"), high.alias("rest")), F.struct((high + second).alias("key"), low.alias("rest")))
    table = distinct.select("fp", F.explode(both).alias("x")).select("fp", "x.key", "x.rest")
    probes = table.select("fp", "key", "rest", F.explode(ball).alias("flip")).select("fp", "rest", F.expr("key ^ flip").alias("key"))
    crowded = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key")
    near = (F.bit_count(F.expr("fp ^ v")) <= MAX_DISTANCE) & (F.col("fp") < F.col("v"))
    plain = probes.join(crowded, "key", "left_anti").join(table.select("key", F.col("fp").alias("v")).hint("merge"), "key").where(near)
    split = lambda side: (
        side.join(crowded, "key", "left_semi")
        .select("fp", "key", "rest", F.explode(ball).alias("flip"))
        .select("fp", "key", F.expr("rest ^ flip").alias("met"))
    )
    close = split(probes).join(split(table).withColumnRenamed("fp", "v").hint("merge"), ["key", "met"]).where(near)
    edges = plain.select("fp", "v").unionByName(close.select("fp", "v"))
    return edges.select(F.col("fp").alias("u"), "v").distinct()


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, __id, __th, fp and component_id, the smallest id of its component."""
    rows = checkpointed(fingerprints(docs, width))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp")))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(known.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")


def one_per_group(docs: DataFrame, width: int = 3) -> DataFrame:
    """The row with the smallest id of every component, all columns; of groups without ids, one row per fingerprint."""
    groups = near_groups(docs, width)
    best = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = best.groupBy("__id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("__fp")).agg(F.min("__th").alias("__th"))
    return rows_of(docs, first)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in 16 hex digits, component_id."""
    hex_digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_groups(docs).select("doc_id", hex_digits.alias("fingerprint"), "component_id")
