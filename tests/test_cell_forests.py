"""Forests learned from tables of cells: the trees of the rows themselves, in one pass a forest."""

import numpy as np
import pytest

from stationfill.operators import cell_forests, chained


def table(spark, x, names):
    kind = "station_id string, t int, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([("a", t, *[None if np.isnan(c) else float(c) for c in row]) for t, row in enumerate(x)], kind)


def filled(df, names):
    return np.array([[r[n] for n in names] for r in sorted(df.collect(), key=lambda r: r.t)])


def by_rows(bins, weight, label, depth):
    """Predictions of a tree on one feature, grown on rows."""
    out = np.full(len(bins), (weight * label).sum() / max(weight.sum(), 1))
    if depth:
        best = None
        for cut in sorted(set(bins))[:-1]:
            sides = [bins <= cut, bins > cut]
            if all(weight[s].sum() for s in sides):
                gain = sum((weight[s] * label[s]).sum() ** 2 / weight[s].sum() for s in sides)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, sides
        if best and best[0] > (weight * label).sum() ** 2 / weight.sum() + 1e-9:
            for s in best[1]:
                out[s] = by_rows(bins[s], weight[s], label[s], depth - 1)
    return out


def test_a_tree_of_cells_is_the_tree_of_the_rows():
    rng = np.random.default_rng(1)
    for depth in (0, 1, 3, 10):
        bins, weight = rng.integers(0, 20, 400), rng.poisson(1.0, 400).astype(float)
        label = np.sin(bins / 3.0) + rng.normal(size=400)
        sums = [np.bincount(bins, x, 20) for x in (weight, weight * (label - 0.25))]
        tree = cell_forests.grown(*sums, [20], depth, rng, 0.25)
        made = cell_forests.CellForest(0, [1], [list(range(19))], [tree]).table()[bins]
        drawn = np.isin(bins, bins[weight > 0])
        assert made[drawn] == pytest.approx(by_rows(bins, weight, label, depth)[drawn])


def test_weights_are_poisson_and_go_by_row_and_tree():
    keys = np.arange(200_000, dtype=np.uint64)
    drawn = np.concatenate([cell_forests._poisson_counts()[cell_forests._draws(keys, cell_forests._salt(0, 0, 0, g))] for g in (0, 1)], axis=1)
    for tree in drawn.T:
        assert tree.mean() == pytest.approx(1, abs=0.02) and tree.var() == pytest.approx(1, abs=0.02)
        assert (tree == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert np.abs(np.corrcoef(drawn.T) - np.eye(8)).max() < 0.02


def test_what_depends_on_others_is_found(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-3, 3, 3000)
    truth = np.stack((a, np.where(a > 0, 5.0, -5.0) + np.abs(a)), axis=1)
    x = truth.copy()
    x[rng.random(3000) < 0.2, 1] = np.nan
    x[:5] = np.nan
    done = filled(chained.forest_chained(table(spark, x, "ab"), ("a", "b"), rounds=2), "ab")
    known = ~np.isnan(x)
    assert np.array_equal(done[known], x[known]) and not np.isnan(done).any()
    hidden = np.isnan(x[:, 1]) & known[:, 0]
    assert np.sqrt(np.mean((done - truth)[hidden, 1] ** 2)) < 0.2


def test_no_matter_how_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1)) + 0.3 * rng.normal(size=(400, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    df = table(spark, x, "abcd")
    one, other = (filled(chained.forest_chained(part, tuple("abcd"), 2, 5, 6), "abcd") for part in (df.coalesce(1), df.repartition(7)))
    assert one == pytest.approx(other)


def test_counts_of_ranges_follow_what_forests_fill_in(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)).round(2)
    x[rng.random(x.shape) < 0.3] = np.nan
    df, means = table(spark, x, "abc"), {"a": 0.1, "b": 0.2, "c": 0.3}
    packs = cell_forests.packed(df, "abc", means).localCheckpoint()
    fine = cell_forests.FineCounts(df, packs, "abc", means)
    forests = [cell_forests.fitted(packs, 3, target, [], fine, (4, 5, 0, 0, 0.0)) for target in (1,)]
    done = filled(cell_forests.completed(df, "abc", means, [forests]), "abc")
    for f, j in fine.now:
        own = done[~np.isnan(x[:, j]), f]
        assert np.array_equal(fine.now[f, j], np.bincount(fine.code(f, own), minlength=len(fine.edges[f])))


def test_rows_are_read_once_a_forest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    x[::7, 1] = np.nan
    df = table(spark, x, "ab").localCheckpoint()
    context = spark.sparkContext
    context.setJobGroup("forests", "")
    try:
        chained.forest_chained(df, ("a", "b"), rounds=3, trees=5, depth=10)
        jobs = len(context.statusTracker().getJobIdsForGroup("forests"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 * 4 + 12


def test_five_variables_go_by_spark_ml(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    done = filled(chained.forest_chained(table(spark, x, "abcde"), tuple("abcde"), 1, 2, 3), "abcde")
    assert np.array_equal(done[~np.isnan(x)], x[~np.isnan(x)]) and not np.isnan(done).any()


@pytest.mark.parametrize("odd", [None, float("inf"), float("nan")])
def test_what_no_forest_can_learn_from_is_refused(spark, odd):
    df = spark.createDataFrame([("a", 1, 1.0, odd), ("a", 2, 2.0, odd), ("a", 3, 3.0, None)], "station_id string, t int, x double, y double")
    with pytest.raises(ValueError, match="'y'"):
        chained.fit_forest(df, ("x", "y"), rounds=1, trees=2, depth=2)
