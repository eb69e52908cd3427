"""Masks as runs, windows and imputations as arrays, quantiles by digits: each against the plain way."""

import datetime as dt
import math
import random
from hashlib import md5

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stationfill.catalog.views import CELLS, PANEL, VARIABLES, Views
from stationfill.operators import chained, ensembles, masks, ranks, score, series, significance
from stationfill.plans import evaluate

NAMES = ("x", "y", "z")
GRID = "station_id string, t int, x double, y double, z double"


@pytest.fixture(scope="module")
def grid(spark):
    draw = random.Random(3)
    cell = lambda: draw.gauss(0, 2) if draw.random() > 0.15 else None
    rows = [(f"s{i}", 5 + t, cell(), cell(), cell()) for i in range(5) for t in range(80 + 10 * i)]
    return spark.createDataFrame(rows, GRID).repartition(4).cache()


@pytest.fixture(scope="module")
def long(grid):
    return series.unfold(grid, NAMES, ["station_id", "t"]).cache()


SPECS = [
    masks.MaskSpec("mcar", 0.3, 1, 9),
    masks.MaskSpec("mar", 0.4, 1, 6, condition_variable="x"),
    masks.MaskSpec("mnar", 0.25, 2, 5, condition_variable="y"),
    masks.MaskSpec("realistic", 0.3),
    masks.MaskSpec("realistic", 0.3, gap_distribution="lognormal"),
]


@pytest.mark.parametrize("spec", SPECS)
def test_a_grid_is_masked_as_the_long_panel_is(spark, grid, long, spec):
    samples = masks.sample_sizes(grid)
    runs = masks.synthetic_runs(samples, NAMES, spec, 7, grid).cache()
    assert {tuple(r) for r in masks.synthetic_mask(samples, NAMES, spec, 7, long).collect()} == {tuple(r) for r in masks.run_cells(runs, NAMES).collect()}
    wanted = masks.apply_mask(long, masks.run_cells(runs, NAMES))
    columns = ["station_id", "t", "variable", "truth", "value", "is_synthetic", "is_eval"]
    got = masks.hidden_panel(grid, NAMES, runs)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, wanted.select(*columns).collect()))
    wide = masks.masked_grid(grid, NAMES, runs)
    assert sorted(map(str, series.unfold(wide, NAMES, ["station_id", "t"]).collect())) == sorted(
        map(str, wanted.select("station_id", "t", "variable", "value").collect())
    )


def test_runs_are_disjoint_and_in_the_order_of_candidates(grid):
    runs = masks.synthetic_runs(masks.sample_sizes(grid), NAMES, SPECS[0], 1).collect()
    seen = set()
    for r in sorted(runs, key=lambda r: (r.station_id, r.k, r.first)):
        cells = {(r.station_id, r.v, t) for t in range(r.first, r.last + 1)}
        assert cells and not cells & seen
        seen |= cells


def test_masks_run_no_job_while_the_plan_is_made(spark, grid):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("masks", "planning")
    for spec in SPECS:
        masks.hidden_panel(grid, NAMES, masks.synthetic_runs(masks.sample_sizes(grid), NAMES, spec, 7, grid))
    jobs = tracker.getJobIdsForGroup("masks")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0


def test_many_variables_take_several_words(spark, monkeypatch):
    monkeypatch.setattr(masks, "_WORD", 2)
    names = tuple("abcde")
    rows = [("s", t, *[float(t + i) for i in range(5)]) for t in range(60)]
    table = spark.createDataFrame(rows, "station_id string, t int, a double, b double, c double, d double, e double")
    runs = masks.synthetic_runs(masks.sample_sizes(table), names, masks.MaskSpec("mcar", 0.5, 1, 5), 2)
    hidden = masks.hidden_panel(table, names, runs).where("is_synthetic").select("t", "variable").collect()
    assert {(r.t, r.variable) for r in hidden} == {(r.t, r.variable) for r in masks.run_cells(runs, names).collect()} and len(hidden) == 150


def test_null_stations_are_not_masked(spark):
    rows = [(None if i == 0 else 10**17 + i, t, 1.0, 2.0, 3.0) for i in range(3) for t in range(40)]
    table = spark.createDataFrame(rows, GRID.replace("string", "bigint"))
    runs = masks.synthetic_runs(masks.sample_sizes(table), NAMES, SPECS[0], 7).collect()
    assert {r.station_id for r in runs} == {10**17 + 1, 10**17 + 2}


# --- quantiles ----------------------------------------------------------------


@pytest.mark.parametrize("kind", ["normal", "awkward", "ties"])
def test_quantiles_equal_numpy(spark, kind):
    draw = np.random.default_rng(4)
    if kind == "normal":
        values = draw.normal(size=997)
    elif kind == "ties":
        values = draw.integers(-3, 3, 500).astype(float)
    else:
        values = np.concatenate([draw.normal(size=50) * 10.0 ** draw.integers(-300, 300, 50), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, np.nextafter(1.0, 2.0)]])
    groups = [["a", "b", None][i % 3] for i in range(len(values))]
    table = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)] + [("a", None), ("empty", None)], "g string, v double").repartition(5)
    ps = [0.0, 0.05, 0.5, 0.731, 1.0]

    def plain(x):
        x, out = np.sort(x), []
        for p in ps:
            spot = (len(x) - 1) * p
            low = math.floor(spot)
            a, b = x[low], x[min(low + 1, len(x) - 1)]
            out.append(a + (b - a) * (spot - low))
        return out

    with np.errstate(over="ignore", invalid="ignore"):
        assert list(ranks.exact_quantiles(table, "v", ps).first()) == pytest.approx(plain(values), rel=1e-15, nan_ok=True)
        got = {r.g: list(r)[1:] for r in ranks.exact_quantiles(table, "v", ps, by="g").collect()}
        assert set(got) == {"a", "b", None}
        for g in got:
            assert got[g] == pytest.approx(plain(values[[x == g for x in groups]]), rel=1e-15, nan_ok=True)


def test_quantiles_of_nothing_and_of_nan(spark):
    table = spark.createDataFrame([(None,)], "v double")
    assert list(ranks.exact_quantiles(table, "v", [0.5]).first()) == [None]
    some = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double")
    assert list(ranks.exact_quantiles(some, "v", [0.0])
                .first()) == [1.0]
    assert math.isnan(ranks.exact_quantiles(some, "v", [1.0]).first()[0])


def test_extremes_run_no_job_while_the_plan_is_made(spark):
    cells = spark.createDataFrame([(float(i), float(i) + 1, True, "x", 1, dt.datetime(2020, 1, 1)) for i in range(100)], "truth double, estimate double, is_eval boolean, variable string, gap_length long, ts timestamp_ntz")
    spark.sparkContext.setJobGroup("extremes", "planning")
    table = score.stratified_metrics(cells)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("extremes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0
    got = {(r.stratification, r.stratum): r.n for r in table.collect()}
    assert got[("extremes", "extreme_low")] == got[("extremes", "extreme_high")] == 5


# --- windows ------------------------------------------------------------------


@pytest.mark.parametrize("window, stride, width", [(10, 3, 12), (24, 24, 24), (7, 1, 4), (90, 5, 16), (500, 10, 64)])
def test_window_arrays_equal_grouped_windows(long, window, stride, width):
    plain = series.packed_windows(series.sliding_windows(long, window, stride))
    got = series.window_arrays(long, window, stride, width=width)
    key = lambda r: (r.station_id, r.variable, r.window_start, [tuple(c) for c in r.cells])
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))


# --- bootstrap ----------------------------------------------------------------


@pytest.mark.parametrize("held", [256, 0])
def test_bootstrap_arrays_equal_exploded_replicas(spark, monkeypatch, held):
    monkeypatch.setattr(significance, "_HELD", held)
    draw = random.Random(9)
    rows = [(f"s{draw.randrange(12)}", draw.choice(["a", "b", None]), draw.choice([1, 2]), draw.gauss(0, 1)) for _ in range(400)]
    errors = spark.createDataFrame(rows, "station_id string, variable string, fold int, err_a double").repartition(5)
    got = {(r.variable, r.fold): r for r in significance.bootstrap_intervals(errors, ["variable", "fold"], replicas=60, seed=3).collect()}
    weight = {}
    for s in {r[0] for r in rows}:
        u = [int(md5(f"3|{r}|{s}".encode()).hexdigest()[:8], 16) / 2**32 for r in range(60)]
        weight[s] = np.array([sum(x >= step for step in significance.POISSON_STEPS) for x in u])
    assert set(got) == {(v, f) for _, v, f, _ in rows}
    for key, r in got.items():
        own = [(s, e) for s, v, f, e in rows if (v, f) == key]
        c = sum(weight[s] for s, _ in own)
        rmse = np.sqrt(sum(weight[s] * e * e for s, e in own)[c > 0] / c[c > 0])
        assert r.replicas == (c > 0).sum()
        assert r.rmse_low == pytest.approx(np.quantile(rmse, 0.025)) and r.rmse_high == pytest.approx(np.quantile(rmse, 0.975))


# --- imputations --------------------------------------------------------------


def test_samples_side_by_side_equal_imputations_one_by_one(spark, grid):
    model = chained.fit_chained(grid, NAMES, rounds=4)
    rows = chained.impute_chained(grid, model, 3, True, 5).collect()
    side = {(r.station_id, r.t): r for r in chained.impute_samples(grid, model, 3, True, 5).collect()}
    assert len(side) == grid.count() and len(rows) == 3 * len(side)
    for r in rows:
        for v in NAMES:
            assert side[r.station_id, r.t][v][r.imputation] == pytest.approx(r[v], rel=1e-12)
    fixed = chained.impute_samples(grid, model, 2, False).first()
    assert fixed.x[0] == fixed.x[1]


def test_evaluation_of_imputations(spark, grid):
    spec = masks.MaskSpec("mcar", 0.3, 1, 4)
    cells = evaluate.hidden_samples(grid, NAMES, spec, 20, seed=11, rounds=4).toPandas()
    hidden = masks.hidden_panel(grid, NAMES, masks.synthetic_runs(masks.sample_sizes(grid), NAMES, spec, 11)).where("is_eval")
    assert {(r.station_id, r.t, r.variable, r.truth) for r in hidden.collect()} == set(cells[["station_id", "t", "variable", "truth"]].itertuples(index=False, name=None))
    got = evaluate.evaluate_imputations(grid, NAMES, spec, 20, seed=11, rounds=4, levels=(0.5, 0.9)).toPandas().set_index("variable")
    assert set(got.index) == {"all", *NAMES}
    for name in got.index:
        part = cells if name == "all" else cells[cells["variable"] == name]
        s, y = np.stack(part["samples"]), part["truth"].to_numpy()
        mean = s.mean(axis=1)
        spread = np.abs(s[:, :, None] - s[:, None, :]).mean(axis=(1, 2)) / 2
        assert got.loc[name, "n"] == len(y)
        assert got.loc[name, "rmse"] == pytest.approx(np.sqrt(((mean - y) ** 2).mean()))
        assert got.loc[name, "crps"] == pytest.approx((np.abs(s - y[:, None]).mean(axis=1) - spread).mean())
        low, high = np.quantile(s, [0.05, 0.95], axis=1)
        assert got.loc[name, "coverage_90"] == pytest.approx(((low <= y) & (y <= high)).mean())
        assert got.loc[name, "width_90"] == pytest.approx((high - low).mean())
    # The same from the arrays by SQL.
    sql = """SELECT avg(list_avg(list_transform(samples, lambda x: abs(x - truth)))
               - list_sum(list_transform(samples, lambda x: list_sum(list_transform(samples, lambda y: abs(x - y))))) / (2.0 * len(samples) * len(samples))) FROM cells"""
    assert got.loc["all", "crps"] == pytest.approx(duckdb.sql(sql).fetchall()[0][0])


# --- the panel's range --------------------------------------------------------


def test_weeks_outside_the_usual_range_are_kept(spark, tmp_path):
    """Lines before 1995 and after 2001 widen every series, in Spark and in SQL alike."""
    days = [dt.datetime(1993, 5, 3), dt.datetime(1999, 1, 4), dt.datetime(2004, 7, 5)]
    table = {"l_suppkey": [1, 2, 1], "l_shipdate": days, "l_quantity": [1.0, 2.0, 3.0], "l_extendedprice": [1.0] * 3, "l_discount": [0.1] * 3, "l_tax": [0.2] * 3}
    pq.write_table(pa.table(table), tmp_path / "lineitem.parquet")
    views = Views(spark, str(tmp_path))
    got = views.panel().select("station_id", "t", "variable", "value").toPandas()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    expected = duck.execute(f"WITH {PANEL} SELECT station_id, t, variable, value FROM panel").df()
    order = ["station_id", "t", "variable"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), expected.sort_values(order, ignore_index=True), check_dtype=False)
    weeks = duck.execute(f"WITH {CELLS} SELECT lo, hi FROM span").fetchone()
    assert weeks[0] < 0 and weeks[1] > 356 and len(got) == 2 * len(VARIABLES) * (weeks[1] - weeks[0] + 1)
    assert got["value"].notna().sum() == 3 * len(VARIABLES)
