"""Anchors and the shallow sort, also where hashes are of no help."""

import numpy as np
import pandas as pd
import pytest

from stationfill.llm import substrings, suffixes

from . import brute
from .conftest import DOCS, prose


def by_id(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans").collect()}


def test_texts_around_a_gram_whose_hash_was_zero(spark):
    """Two equal texts of 56 bytes around a gram that an earlier hash took for no anchor."""
    text = "a line of twenty by " + "}/*([< `nv0aAvNG" + " and twenty after it"
    rows = [(1, text), (2, text), (3, text.replace("`", "'")), (4, text.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert len(text) == 56
    assert by_id(substrings.repeated(docs)) == {i: x[:3] for i, x in brute.substrings(rows).items()}


@pytest.mark.parametrize("constant", [0, 1, 7])
def test_every_window_has_an_anchor_whatever_the_hash(monkeypatch, constant):
    """Even if all grams had one hash, or a hash of zero, no window would be without an anchor."""
    if constant:  # else the real function, which the NUL bytes below give words of zero
        monkeypatch.setattr(substrings, "_hash", lambda *w: np.full(len(w[0]), constant, np.uint64))
    texts = ["\0" * 70, "x" * 50, "y" * 49, "", prose(1, 40)]
    shard = substrings.Shard(pd.DataFrame({"__id": range(5), "__th": 0, "text": texts}))
    assert (shard.hash > 0).all()
    for start, end in zip(shard.starts, shard.ends):
        for p in range(start, end - substrings.LENGTH + 1):
            assert any(p <= a <= p + substrings.REACH for a in shard.at)


def test_hashes_are_never_zero():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 2**63, (4, 100_000)).astype(np.uint64)
    words[:, :10] = 0
    assert (substrings._hash(*words) > 0).all()


def test_anchors_of_one_hash_are_told_apart_by_their_bytes():
    """Records of two grams that share a group only if their bytes do."""
    draw = np.random.default_rng(2)
    width = substrings.REACH + substrings.LENGTH
    around = draw.integers(97, 99, (300, width)).astype(np.uint8)
    around[::2] = around[0]
    grams = around[:, substrings.REACH : substrings.REACH + substrings.GRAM]
    group = substrings._numbered(grams)
    assert len(set(group[::2])) == 1 and len(set(group)) > 100
    assert len(set(group)) == len({g.tobytes() for g in grams}) == len({(n, g.tobytes()) for n, g in zip(group, grams)})
    assert substrings._numbered(grams[:0]).tolist() == []


@pytest.mark.parametrize("few", [1, 3, 50, 10_000])
def test_multikey_quicksort(few):
    draw = np.random.default_rng(few)
    for n in (0, 1, 2, 500):
        keys = draw.integers(0, 4, (n, 4)).astype(np.uint64)
        keys[: n // 2] = 2**64 - 1
        order = suffixes.multikey_quicksort(keys, few)
        assert sorted(order.tolist()) == list(range(n))
        assert [tuple(keys[i]) for i in order] == sorted(map(tuple, keys))


def test_quicksort_then_tries(monkeypatch):
    monkeypatch.setattr(suffixes, "FEW", 4)
    monkeypatch.setattr(suffixes.multikey_quicksort, "__defaults__", (4,))
    draw = np.random.default_rng(5)
    data = draw.integers(0, 2, (600, 18)).astype(np.uint8)
    data[::2, :17] = 1
    groups = draw.integers(0, 4, 600)
    order = suffixes.sorted_order(groups, data)
    rows = [(groups[i], data[i].tobytes()) for i in order]
    assert rows == sorted(rows)


def test_many_shards_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(substrings, "RANGE_BYTES", 100)
    passage = prose(3, 30)
    rows = [(i, prose(10 + i, 20) + " " + (passage if i % 3 else passage[: 40 + i]) + prose(50 + i, 4)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    assert by_id(substrings.repeated(docs, shard_bytes=500)) == {i: x[:3] for i, x in brute.substrings(rows).items()}


@pytest.mark.parametrize("constant", [0, 7])
def test_a_window_is_told_of_at_one_anchor(monkeypatch, constant):
    """Equal windows at equal places, so nothing is sent twice and nothing is missed."""
    if constant:
        monkeypatch.setattr(substrings, "_hash", lambda *w: np.full(len(w[0]), constant, np.uint64))
    common = prose(7, 30)
    texts = ["\0" * 70, "x" * 50, "y" * 49, "", prose(1, 40) + common, common + prose(2, 9), "ab" * 60]
    shard = substrings.Shard(pd.DataFrame({"__id": range(7), "__th": 0, "text": texts}))
    told = [(a - back, back) for a, left, right in zip(shard.at, shard.left, shard.right) for back in range(substrings.LENGTH - right, left + 1)]
    windows = [p for start, end in zip(shard.starts, shard.ends) for p in range(start, end - substrings.LENGTH + 1)]
    assert sorted(p for p, _ in told) == windows and all(0 <= back <= substrings.REACH for _, back in told)
    places: dict[bytes, set[int]] = {}
    for p, back in told:
        places.setdefault(shard.data[p : p + substrings.LENGTH].tobytes(), set()).add(back)
    assert all(len(x) == 1 for x in places.values())


@pytest.mark.parametrize("wide", [4, 15])
def test_crowds_of_documents_are_dealt_out_alike(spark, wide):
    passage = prose(3, 30)
    rows = [(i, prose(10 + i, 20) + " " + (passage if i % 3 else passage[: 40 + i]) + prose(50 + i, 4)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert by_id(substrings.repeated(docs, wide=wide)) == {i: x[:3] for i, x in brute.substrings(rows).items()}
