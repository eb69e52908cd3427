"""More sets of missing variables than the driver holds: the same fits and imputations."""

import random

import numpy as np
import pytest

from stationfill.operators import chained, chained_sets

NAMES = tuple("abcdef")


@pytest.fixture(scope="module")
def wide(spark):
    draw = random.Random(8)
    rows = []
    for i in range(500):
        base = draw.gauss(0, 1)
        values = [base * (j + 1) + draw.gauss(0, 0.5) + 10 * j for j in range(6)]
        rows.append((f"s{i % 7}", i, *[v if draw.random() > 0.35 else None for v in values]))
    return spark.createDataFrame(rows, "station_id string, t int, " + ", ".join(f"{n} double" for n in NAMES)).repartition(3).cache()


def table(df):
    return {(r.station_id, r.t, getattr(r, "imputation", 0)): [r[n] for n in NAMES] for r in df.collect()}


@pytest.mark.parametrize("predictor", ["bayesian_ridge", "linear"])
def test_same_fit_and_imputations(wide, monkeypatch, predictor):
    assert len(chained._occurring(wide, NAMES)) > 40
    one = chained.fit_chained(wide, NAMES, rounds=5, predictor=predictor, tolerance=1e-3)
    side = table(chained.impute_samples(wide, one, 3, True, 4))
    rows = table(chained.impute_chained(wide, one, 2, False))
    monkeypatch.setattr(chained, "MAX_SETS", 3)
    assert chained._occurring(wide, NAMES) is None
    other = chained.fit_chained(wide, NAMES, rounds=5, predictor=predictor, tolerance=1e-3)
    assert len(other.steps) == len(one.steps)
    for x, y in zip(one.steps, other.steps):
        assert x[:2] == y[:2] and np.allclose([x[2], *x[3], x[4]], [y[2], *y[3], y[4]], rtol=1e-6, atol=1e-9)
    got = table(chained.impute_samples(wide, one, 3, True, 4))
    assert set(got) == set(side)
    for key in side:
        for a, b in zip(side[key], got[key]):
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)
    again = table(chained.impute_chained(wide, one, 2, False))
    assert set(again) == set(rows)
    for key in rows:
        np.testing.assert_allclose(rows[key], again[key], rtol=1e-9)


def test_stopping_rule_counts_the_same_changes(wide):
    model = chained.fit_chained(wide, NAMES, rounds=4, tolerance=0)
    driver = chained._round_changes(wide, model, 4, chained._occurring(wide, NAMES))
    np.testing.assert_allclose(driver, chained_sets.round_changes(wide, model, 4), rtol=1e-9)
    assert driver == sorted(driver, reverse=True)


def test_twenty_variables_with_as_many_sets_as_rows(spark, monkeypatch):
    monkeypatch.setattr(chained, "MAX_SETS", 50)
    draw = np.random.default_rng(3)
    names = tuple(f"v{i}" for i in range(20))
    values = draw.normal(size=(400, 1)) + 0.1 * draw.normal(size=(400, 20))
    holes = draw.random((400, 20)) < 0.4
    rows = [("s", i, *[None if h else float(v) for v, h in zip(x, y)]) for i, (x, y) in enumerate(zip(values, holes))]
    table = spark.createDataFrame(rows, "station_id string, t int, " + ", ".join(f"{n} double" for n in names))
    assert len(np.unique(holes, axis=0)) > 390
    model = chained.fit_chained(table, names, rounds=2, tolerance=0)
    done = chained.impute_chained(table, model).orderBy("t").collect()
    guess = np.array([[r[n] for n in names] for r in done])
    assert np.allclose(guess[~holes], values[~holes])
    assert np.sqrt(((guess - values)[holes] ** 2).mean()) < 0.2  # other variables say what is missing up to their noise
