"""The pipeline's near duplicates against the Jaccard similarity of all pairs."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from stationfill.llm import jaccard, shared_shingles, simhash

from . import brute
from .conftest import DOCS, prose

GIVEN = "/root/testdata/sf0.001"


def kept(rows):
    """The smallest id of every component of five-word similarity 0.8, for (doc_id, text) rows."""
    sets = {}
    for i, text in rows:
        words = [w for w in brute.SPACE.split((text or "").translate(brute.LOWER)) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def changed(text, seed, n):
    words, draw = text.split(), random.Random(seed)
    for k in draw.sample(range(len(words)), n):
        words[k] = f"other{seed}x{k}"
    return " ".join(words)


def after(spark, docs):
    out = corpus_pipeline.simhash_near_dedup(spark, docs, GIVEN)
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_one_changed_word_of_a_hundred(spark):
    text = prose(900, 100)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, changed(text, 1, 1), "en", "s", 1), (3, prose(901, 100), "en", "s", 1)], DOCS)
    assert after(spark, docs) == [1, 3]


@pytest.mark.parametrize("chunk, chars, crowd, pairs", [(1 << 21, 1 << 24, 64, 2), (500, 900, 0, 0), (1 << 21, 1 << 24, 64, 10**9)])
def test_around_the_threshold(spark, monkeypatch, chunk, chars, crowd, pairs):
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", pairs)
    monkeypatch.setattr(shared_shingles, "CHUNK", chunk)
    monkeypatch.setattr(shared_shingles, "BUCKET_CHARS", chars)
    monkeypatch.setattr(simhash.links, "__defaults__", (crowd,))
    tail = " " + prose(903, 30)  # a passage that every text has
    texts = [changed(prose(910 + g, 60 + 40 * g), 7 * g + k, 1 + k % 5) + tail for g in range(6) for k in range(12)]
    rows = list(enumerate(texts)) + [(200, "One two"), (201, "one  TWO"), (202, "one two three"), (203, None), (204, " "), (205, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    expected = sorted(kept(rows))
    assert 10 < len(expected) < 60
    assert after(spark, docs) == expected


def test_repeated_and_missing_ids(spark):
    text = prose(920, 80)
    rows = [(None, text), (None, changed(text, 1, 1)), (5, prose(921, 60)), (5, prose(922, 60)), (5, prose(922, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = corpus_pipeline.simhash_near_dedup(spark, docs, GIVEN).collect()
    assert sorted(str(r.doc_id) for r in left) == ["5", "5", "None"]
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), GIVEN).count() == 0


def test_very_long_and_repeated_texts(spark):
    """A text longer than a chunk, one word over and over, and a crowd with a passage that is most of each."""
    long = prose(930, 30_000)
    rows = [(1, long), (2, changed(long, 1, 600)), (3, changed(long, 2, 3000)), (4, "x " * 50_000), (5, "x " * 10)]
    passage = prose(931, 90)
    rows += [(100 + k, passage + " " + prose(940 + k, 4 + k % 9)) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    assert after(spark, docs) == sorted(kept(rows))


def test_candidates_of_simhash_and_what_is_left_for_the_exact_way(spark):
    """Multi-index hashing links long texts with a word changed; prefix filtering brings the pairs that differ more."""
    texts = [prose(950 + g, 4000 if g < 8 else 100) for g in range(30)]
    rows = [(2 * g, t) for g, t in enumerate(texts)] + [(2 * g + 1, changed(t, g, 1 if g < 8 else 2)) for g, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    named = docs.selectExpr("unhex(md5(text)) AS node", "text")
    found = jaccard.simhash_candidates(shared_shingles.sharers(named)).count()
    expected = sorted(kept(rows))
    assert 4 <= found < 60 - len(expected)
    assert after(spark, docs) == expected


def test_parity_maps_bound_the_difference():
    draw = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 400, draw.integers(1, 300)).astype(np.uint64) << np.uint64(7)) for _ in range(2))
        bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(shared_shingles.parity_map(a).view("u8"), shared_shingles.parity_map(b).view("u8")))
        assert bits <= len(np.setxor1d(a, b))


def test_shared_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(shared_shingles, "CHUNK", 100)
    monkeypatch.setattr(shared_shingles, "BUCKET_CHARS", 300)
    base = prose(960, 60)
    rows = [(k, changed(base, k, k % 4) if k % 3 else prose(961 + k, 50)) for k in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "i int, text string").repartition(4)
    sets = {t: set(shared_shingles.shingle_set(t).tolist()) for _, t in rows}
    got = {r.node: r for r in shared_shingles.sharers(docs.selectExpr("unhex(md5(text)) AS node", "text")).collect()}
    expected = {}
    for t, own in sets.items():
        count = {h: sum(h in o for o in sets.values()) for h in own}
        alone = sum(c == 1 for c in count.values())
        if 5 * alone <= len(own):
            shared = sorted(h for h, c in count.items() if c > 1)
            firsts = sorted(shared, key=lambda h: (count[h], h))[: len(own) // 5 + 1 - alone]
            expected[bytes.fromhex(brute.md5(t))] = (len(own), alone, shared, firsts)
    assert {k: (r.n, r.alone, np.frombuffer(r.own, np.uint64).tolist(), r.firsts) for k, r in got.items()} == expected


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")
def test_given(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    assert after(spark, docs) == sorted(kept([(r.doc_id, r.text) for r in docs.collect()]))
