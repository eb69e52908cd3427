"""Pairs counted by range against pairs compared one by one."""

import time

import numpy as np
import pandas as pd
import pytest

from stationfill.operators import dominance, stations


@pytest.mark.parametrize("seed", range(6))
def test_near_pairs(seed):
    draw = np.random.default_rng(seed)
    n, m = draw.integers(0, 60, 2)
    group_a, group_b = draw.integers(0, 5, n), draw.integers(0, 6, m)
    # Few distinct values, so that distances equal to the limit occur; b is never below a.
    a, b = draw.integers(0, 6, (n, 2)) / 10.0, 0.5 + draw.integers(0, 8, (m, 2)) / 10.0
    wa, wb = draw.integers(1, 4, n), draw.integers(1, 4, m)
    kinds = np.array([[True, False], [False, True], [True, True]])[draw.integers(0, 3, 6)]
    expected = sum(
        int(wa[i] * wb[j])
        for i in range(n)
        for j in range(m)
        if group_a[i] == group_b[j] and all(not kinds[group_a[i], c] or b[j, c] - a[i, c] <= 0.7 for c in (0, 1))
    )
    got = dominance.near_pairs(group_a, a, wa, group_b, b, wb, kinds[group_a] if n else np.zeros((0, 2), bool), 0.7)
    assert got == expected


def table(spark, places):
    rows = [(i, float(x), float(y), None, 1) for i, (x, y) in enumerate(places)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["station_id", "latitude", "longitude", "last_observation", "total_observation_count"]).drop(columns="last_observation"))


@pytest.mark.parametrize("seed, threshold", [(1, 0.01), (2, 0.05), (3, 0.5), (4, 0.03)])
def test_pairs_of_stations(spark, seed, threshold):
    draw = np.random.default_rng(seed)
    places = np.round(draw.uniform(-0.3, 0.3, (250, 2)), 2)
    near = (np.abs(places[:, None, :] - places[None, :, :]) <= threshold).all(axis=2)
    expected = (int(near.sum()) - len(places)) // 2
    assert stations.duplicate_pair_count(table(spark, places), threshold).first()[0] == expected


def test_crowded_cells_do_not_cost_the_square(spark):
    """100,000 places in one cell and as many three cells on: ten thousand million pairs to tell apart."""
    draw = np.random.default_rng(5)
    width = 0.01 * 0.4999
    near = draw.uniform(0, width, (100_000, 2))
    far = draw.uniform(0, width, (100_000, 2)) + [2 * width, 2 * width]
    started = time.perf_counter()
    got = stations.duplicate_pair_count(table(spark, np.concatenate((near, far))), 0.01).first()[0]
    took = time.perf_counter() - started
    # The same count by sorting one coordinate and summing over the other in slices.
    inside = 2 * (100_000 * 99_999 // 2)
    cross = 0
    for part in np.array_split(near[:2000], 20):
        cross += int((np.abs(part[:, None, :] - far[None, :, :]) <= 0.01).all(axis=2).sum())
    assert got > inside and abs((got - inside) / 1e10 - cross / 2e8) < 0.01
    assert took < 120
