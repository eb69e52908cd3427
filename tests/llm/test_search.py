"""Ranked search against scores of every document, and the bound's behaviour on single lists."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.llm import op_queries, search

from .conftest import DOCS, prose

GIVEN = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Sorted (item_id, rank, doc_id, score), rows of either table one by one."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w in held)
    counts = [{t: w.count(t) for t in set(w)} for _, w in held]
    out = []
    for item_id, text in items:
        asked = terms(text)
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counts) + 1))) for t in set(asked)}
        found = []
        for (i, w), c in zip(held, counts):
            m = 100 - 75 + (75 * len(w) * n) // length
            s = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(out, key=str)


def rows(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows(spark, awkward, crowded, monkeypatch):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, prose(1, 12)), (2, "the the THE river"), (3, None), (4, "-- !"), (None, "stone"), (5, "é中😀 nowhere"), (5, "cloud"), (6, "x" * 30_000), (7, "unheard")]
    asked = spark.createDataFrame(items, ITEMS)
    expected = brute(docs, items)
    assert rows(search.ranked(awkward, asked)) == expected
    extra = {c: F.lit("mine") for c in ("item", "rank", "score", "id", "ids", "docs", "terms", "salt", "df")}
    monkeypatch.setattr(search, "SHARD_BYTES", 500)
    monkeypatch.setattr(search, "MAX_QUESTION_WORDS", 13)
    monkeypatch.setattr(search, "PIECE", 7)
    monkeypatch.setattr(search, "FIRST_READ", 1)
    assert rows(search.ranked(crowded.withColumns(extra).repartition(3), asked.withColumns(extra))) == expected


def test_empty_tables(spark, awkward):
    asked = spark.createDataFrame([(1, "the")], ITEMS)
    assert rows(search.ranked(awkward.limit(0), asked)) == []
    assert rows(search.ranked(awkward, asked.limit(0))) == []
    assert rows(search.ranked(awkward.where("text IS NULL OR text = ''"), asked)) == []


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_copies(spark, seed):
    """Few words, equal texts: many equal scores at the k-th place."""
    draw = random.Random(seed)
    docs = [(draw.randrange(400), " ".join(draw.choices("aa bb cc dd ee ff".split(), k=draw.choice((1, 2, 2, 3, 30))))) for _ in range(300)]
    items = [(i, " ".join(draw.choices("aa bb cc dd ee ff gg".split(), k=4))) for i in range(12)]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS).repartition(4)
    assert rows(search.ranked(table, spark.createDataFrame(items, ITEMS), 7)) == brute(docs, items, 7)


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")
def test_given(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{GIVEN}/benchmark.parquet").collect()]
    assert rows(op_queries.op12_ranked_search(spark, GIVEN)) == brute(docs, items)


def impact_list(draw, n, size):
    docs = np.sort(draw.choice(n, size, replace=False)).astype(np.int64)
    return search.ImpactList.of(docs, draw.integers(1, 9, size), np.full(n, 100))


def test_stops_early_and_misses_nothing():
    draw = np.random.default_rng(3)
    n = 5000
    for _ in range(20):
        lists = [impact_list(draw, n, int(draw.integers(1, n))) for _ in range(4)]
        weights = draw.integers(1, 50, 4).tolist()
        whole = np.zeros(n, np.int64)
        for x, w in zip(lists, weights):
            whole[x.docs] += w * x.impacts
        met, scores, read = search.best_positions(lists, weights, n, 10)
        assert (whole[met] == scores).all() and len(set(met.tolist())) == len(met)
        kth = np.sort(whole)[-10]
        assert set(np.flatnonzero(whole >= max(kth, 1))) <= set(met.tolist())
        assert read <= sum(len(x.docs) for x in lists)
    # One list whose first entries stand out: two reads settle it.
    counts = np.r_[np.full(20, 1000), np.ones(n - 20, np.int64)]
    met, _, read = search.best_positions([search.ImpactList.of(np.arange(n), counts, np.full(n, 100))], [1], n, 10)
    assert read == search.FIRST_READ and len(met) == read
    # A known floor above all scores ends it with the first read.
    _, _, read = search.best_positions([search.ImpactList.of(np.arange(n), np.ones(n, np.int64), np.full(n, 100))], [1], n, 10, 10**9)
    assert read == search.FIRST_READ
