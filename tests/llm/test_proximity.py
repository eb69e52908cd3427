"""Proximity search against every window of words, all documents in one shard."""

import os
from collections import Counter

import pytest

from stationfill.llm import contamination, op_queries

from . import brute
from .conftest import DOCS

GIVEN = "/root/testdata/sf0.001"


def expected(rows, items, terms=3, span=13):
    """doc_id -> items whose rarest terms all occur in some ``span`` words of the document."""
    texts = {i: brute.words(t) for i, t in rows}
    count = Counter(w for t in texts.values() for w in t)
    out = {i: [] for i in texts}
    for name, text in items:
        rare = set(sorted(set(brute.words(text)), key=lambda w: (count[w], w.encode()))[:terms])
        for i, t in texts.items():
            if rare and any(rare <= set(t[k : k + span]) for k in range(len(t))):
                out[i].append(str(name))
    return {i: (len(x), brute.sha(",".join(sorted(x)))) for i, x in out.items()}


def test_documents_do_not_run_together(spark):
    rows = [(1, "one two three alpha"), (2, "beta zeta four five"), (3, "zeta one two alpha three beta"), (4, "alpha " + "x " * 40 + "beta zeta"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).coalesce(1)
    items = [(1, "alpha beta zeta"), (2, "five"), (3, "alpha beta"), (4, "absent alpha")]
    got = contamination.digests(docs, spark.createDataFrame(items, "item_id long, text string"), near=True)
    assert {r.doc_id: (r.n_near_items, r.near_items_sha256) for r in got.collect()} == expected(rows, items)


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")
def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{GIVEN}/benchmark.parquet").collect()]
    got = op_queries.queries()["op4_benchmark_proximity"](spark, GIVEN).collect()
    assert {r.doc_id: (r.n_near_items, r.near_items_sha256) for r in got} == expected(rows, items)
    assert {r.doc_id: tuple(r)[1:6] for r in got} == brute.contamination(rows, items)
