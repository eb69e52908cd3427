"""Near duplicates: word shingles with a Jaccard similarity of 0.8 or more, every pair of them.

1. Texts with more than a fifth of shingles of their own can be similar to none and go first, by
   exact counts (``shared_shingles``). What is left knows its rarest shared shingles.
2. SimHash with multi-index hashing links most of the others: fingerprints of the same shingles meet
   in segment tables, and candidates are settled on shingle sets. A crowd of near copies becomes
   one component here.
3. No radius of SimHash covers 0.8 for certain: such pairs differ in about ten of 64 bits, more or
   fewer by chance. The exact remainder comes from prefix filtering: in the order of frequency,
   rarest first, two such texts share a shingle among the first fifth (and one) of either. Where
   texts of several components share one of those, they are compared with one text drawn from the
   shingle's, who is done then; this is repeated as long as it pays, and what is left is listed in full.

Sizes, places and parity maps of the sets rule pairs out before sets are looked at; each of these is
a bound, so nothing is lost. Candidates are compared on what they share with other texts and on
their sizes, which is exact.
Null text is empty; texts of fewer words than a shingle are one shingle, texts without words are
equal. Texts count as equal if their 128-bit digests are, shingles if 56 bits are. Ids may be null
or repeated. Stored tables are deleted once they are superseded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import keyed, rows_of
from .components import connected_components
from .scratch import Scratch
from .shared_shingles import MAP_WORDS, WIDTH, sharers


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose shingle sets are similar at 0.8 or more."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b, n in zip(batch.column("a"), batch.column("b"), batch.column("n").to_pylist()):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                keep.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * n)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sides = [texts.select(F.col("node").alias(x), F.col("own").alias(own), F.col("n").alias(f"n{x}")) for x, own in (("u", "a"), ("v", "b"))]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    # Sizes alone rule some out before sets are looked at.
    fits = F.least("nu", "nv") * 5 >= F.greatest("nu", "nv") * 4
    return both.where(fits).select("u", "v", "a", "b", (F.col("nu") + F.col("nv")).alias("n")).mapInArrow(similar, "u binary, v binary")


#: What an entry carries of its text.
_OF = ("node", "n", "alone", "at", *(f"map{i}" for i in range(MAP_WORDS)), "root")
#: Pairs an entry may have left on average for all of them to be listed.
PAIRS_PER_ENTRY = 2


def _possible() -> Column:
    """Of rows with the columns of ``_OF`` twice, the second time numbered 2: whether 0.8 is possible."""
    both = F.col("n").cast("long") + F.col("n2")
    # At the first shingle that two texts share, what lies behind it must suffice.
    behind = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")).cast("long")
    apart = sum((F.bit_count(F.col(f"map{i}").bitwiseXOR(F.col(f"map{i}2"))) for i in range(MAP_WORDS)), F.col("alone") + F.col("alone2"))
    return (9 * behind >= 4 * both) & (9 * (both - apart) >= 8 * both) & (F.col("root") != F.col("root2"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.where(_possible()).select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()


def simhash_candidates(texts: DataFrame) -> DataFrame:
    """Pairs (u, v) of texts whose fingerprints multi-index hashing links; equal ones go with their smallest node."""
    least = texts.groupBy("fp").agg(F.min("node").alias("node"))
    same = texts.select("node", "fp").join(least.withColumnRenamed("node", "first"), "fp").where("node <> first")
    met = simhash.links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in ("u", "v")]
    near = met.join(ends[0], "u").join(ends[1], "v").select("node_u", "node_v")
    return same.select(F.col("first").alias("u"), F.col("node").alias("v")).unionByName(near.toDF("u", "v"))


def _across(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with their component's root, of shingles that several components have."""
    rooted = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    return rooted.join(several, "h")


def _pairs_left(live: DataFrame) -> tuple[float, int]:
    """Pairs of one entry and different components, and entries' rows."""
    sizes = live.groupBy("h", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("h")
    left = sizes.agg(F.sum("k").cast("double").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    found = left.agg(F.sum(F.col("s") * F.col("s") - F.col("q")) / 2, F.sum("s")).first()
    return found[0] or 0.0, found[1] or 0


def components(rows: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """node and root for every text (node, text) that is similar to another."""
    texts = scratch.keep(sharers(rows, width).dropDuplicates(["node"]))
    edges = scratch.keep(verified(simhash_candidates(texts).distinct(), texts))
    roots = scratch.keep(connected_components(edges))
    entries = texts.select(
        "node", "n", "alone", *[c for c in _OF if c.startswith("map")], F.posexplode("firsts").alias("place", "h")
    ).select("h", *[c for c in _OF if c not in ("at", "root")], (F.col("alone") + F.col("place")).alias("at"))
    live, before, turn, last = scratch.keep(_across(entries, roots)), float("inf"), 0, False
    while not last:
        pairs, size = _pairs_left(live)
        if not pairs:
            break
        last = pairs <= PAIRS_PER_ENTRY * size or pairs > before / 2
        before, turn = pairs, turn + 1
        if last:
            met = live.join(live.select("h", *[F.col(c).alias(f"{c}2") for c in _OF]), "h").where("node < node2")
            rest = live.limit(0)
        else:
            one = live.groupBy("h").agg(F.min(F.struct(F.xxhash64("node", "h", F.lit(turn)).alias("draw"), *_OF)).alias("one"))
            met = live.join(one.select("h", *[F.col(f"one.{c}").alias(f"{c}2") for c in _OF]), "h")
            rest = met.where("node <> node2").select(*live.columns)
        found = scratch.keep(verified(_pairs(met), texts))
        more = scratch.keep(edges.unionByName(found))
        joined = scratch.keep(connected_components(more))
        left = scratch.keep(_across(rest.drop("root"), joined))
        scratch.drop(live, found, edges, roots)
        edges, roots, live = more, joined, left
    scratch.drop(texts, edges, live)
    return roots


def one_per_group(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The row with the smallest id of every component, all columns; of components without ids, one row."""
    rows = keyed(docs).withColumn("node", F.unhex(F.md5("text")))
    roots = components(rows, Scratch(docs.sparkSession), width)
    keys = rows.withColumn("doc_id", F.col("doc_id").cast("long")).select("doc_id", "__id", "__th", "node")
    known = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), "__id", "__th")
    best = known.groupBy("root").agg(F.min(order).alias("best")).select("best.*")
    return rows_of(docs, best.select("__id", "__th"))
