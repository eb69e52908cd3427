"""Whitening against exact integers and a dense decomposition."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.llm import op_queries, whitening

GIVEN = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check(rows, got, components=32):
    """``rows``: (vec_id, vector) with different ids that are all usable."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-10).sum()))
    assert len(got) == n * k
    out = np.full((n, k), np.nan)
    place = {i: p for p, (i, _) in enumerate(rows)}
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and 0 <= r.identity_error <= 1e-4
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * r.explained
        out[place[r.vec_id], r.component - 1] = r.whitened
    expected = y @ (vectors[:, :k] / np.sqrt(values[:k]))
    # Signs are free; directions of nearly equal eigenvalues are not settled, so only the others are compared.
    for c in range(k):
        gaps = [abs(values[c] - values[o]) for o in (c - 1, c + 1) if 0 <= o < len(values)]
        if not gaps or min(gaps) > 1e-6 * values[0]:
            sign = np.sign(expected[:, c] @ out[:, c])
            np.testing.assert_allclose(out[:, c], sign * expected[:, c], atol=1e-6)
    np.testing.assert_allclose(out.T @ out / n, np.eye(k), atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")
def test_given(spark):
    got = op_queries.op13_embedding_whitening(spark, GIVEN)
    assert got.columns == COLUMNS
    table = spark.read.parquet(f"{GIVEN}/embeddings.parquet").collect()
    check([(r.vec_id, r.embedding) for r in table], got.collect())


def vectors(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return [(i, (draw.normal(size=d) * np.arange(1, d + 1)).tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1024])
def test_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rows = vectors(50, 3)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(rows, whitening.digests(table).collect())


def test_more_columns_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 4)
    table = spark.createDataFrame(vectors(40, 6), "vec_id long, embedding array<double>")
    rows = integers = whitening.integers(table)
    n, total = whitening.sums(rows)
    matrix = whitening.blocks(whitening.centred(integers, n, total), n, len(total))
    y = np.array([r.y for r in whitening.centred(integers, n, total).orderBy("__row").collect()])
    np.testing.assert_allclose(whitening.own_product(matrix), y.T @ y, rtol=1e-12)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(20, 3)
    rows = good + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    rows += [(None, [3.0, 2.0, 1.0]), (5, good[5][1]), (5, good[5][1])]
    names = ["x", "y", "key", "n", "__row", "__at", "__v", "whitened", "deviation", "component"]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in names})
    got = whitening.digests(table).collect()
    assert len(got) == 23 * 3 and {r.n for r in got} == {23}
    assert sum(r.vec_id == 5 for r in got) == 9 and sum(r.vec_id is None for r in got) == 3
    assert not {r.vec_id for r in got} & set(range(100, 110))
    empty = whitening.digests(table.limit(0))
    assert empty.columns == COLUMNS and empty.count() == 0
    assert whitening.digests(table.where("vec_id >= 100")).where("vec_id <> 105").count() == 0


def test_no_variance_and_large_entries(spark):
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(9)], "vec_id long, embedding array<float>")
    assert whitening.digests(same).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 0.25]) for i in range(9)], "vec_id long, embedding array<float>")
    check([(i, [float(i), 0.25]) for i in range(9)], whitening.digests(flat).collect())
    wide = [(i, [float(i) * 2.0**40, float(i * i % 7)]) for i in range(9)]
    got = whitening.digests(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got if r.vec_id != 4} == {None} and len(got) >= 9


def test_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_LENGTH", 2)
    table = spark.createDataFrame(vectors(10, 3), "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="at most 2"):
        whitening.digests(table)
