"""Chained equations, metrics, paired tests, ensembles, climate indices, end-to-end plans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.operators import chained, downstream, ensembles, imputers, masks, score, significance
from stationfill.plans import evaluate as plan

V = ("a", "b", "c")
WIDE = "station_id string, t int, a double, b double, c double"


def correlated(seed=0, n=400, missing=0.25):
    rng = np.random.default_rng(seed)
    a = rng.normal(10, 3, n)
    x = np.column_stack([a, 2 * a + rng.normal(0, 1, n), 5 - a + rng.normal(0, 2, n)])
    x[rng.random(x.shape) < missing] = np.nan
    return x


def wide(spark, x):
    return spark.createDataFrame([("s", i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], WIDE)


def filled(df):
    return np.array([[r.a, r.b, r.c] for r in df.orderBy("t").collect()])


def chain_by_rows(x, rounds):
    """Least-squares chain on the full matrix, row by row."""
    miss = np.isnan(x)
    done = np.where(miss, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for j in np.argsort(miss.sum(axis=0), kind="stable"):
            others = [k for k in range(x.shape[1]) if k != j]
            design = np.column_stack([np.ones(len(x)), done[:, others]])
            coef = np.linalg.lstsq(design[~miss[:, j]], x[~miss[:, j], j], rcond=None)[0]
            done[miss[:, j], j] = design[miss[:, j]] @ coef
    return done


@pytest.mark.parametrize("rounds", [1, 4])
def test_moments_give_the_row_wise_chain(spark, rounds):
    x = correlated()
    df = wide(spark, x)
    model = chained.fit_chained(df, V, rounds, "linear", tolerance=0)
    got = filled(chained.impute_chained(df, model))
    assert got == pytest.approx(chain_by_rows(x, rounds), rel=1e-8)
    assert np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)])


def test_rounds_stop_once_nothing_moves(spark):
    x = correlated()
    df = wide(spark, x)
    model = chained.fit_chained(df, V, 30, "linear", tolerance=0.02)
    used = model.steps[-1][0] + 1
    states = [np.where(np.isnan(x), np.nanmean(x, axis=0), x)] + [chain_by_rows(x, r) for r in range(1, 31)]
    limit = 0.02 * np.nanmax(np.abs(x))
    moved = [np.abs(b - a).sum(axis=1).max() for a, b in zip(states, states[1:])]
    assert 1 < used < 30 and used == next(i for i, m in enumerate(moved, 1) if m < limit)


def test_bayesian_ridge_maximises_the_evidence():
    """Coefficients solve the ridge system, and both precisions reproduce themselves."""
    rng = np.random.default_rng(8)
    n, x = 300, rng.normal(size=(300, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.normal(0, 0.7, n)
    x, y = x - x.mean(axis=0), y - y.mean()
    coef, noise, spread = chained._ridge(x.T @ x, x.T @ y, y @ y, n, True)
    alpha = 1 / noise
    weight = np.diag(np.linalg.inv(spread) - alpha * x.T @ x).mean()
    assert coef == pytest.approx(np.linalg.solve(x.T @ x + weight / alpha * np.eye(3), x.T @ y))
    eigen = alpha * np.linalg.eigvalsh(x.T @ x)
    used = (eigen / (weight + eigen)).sum()
    assert weight == pytest.approx(used / (coef @ coef), rel=1e-2)
    assert alpha == pytest.approx((n - used) / ((y - x @ coef) ** 2).sum(), rel=1e-2)


def test_model_survives_writing(spark, tmp_path):
    x = correlated()
    df = wide(spark, x)
    model = chained.fit_chained(df, V)
    model.to_frame(spark).write.parquet(f"{tmp_path}/model")
    again = chained.ChainedModel.from_frame(spark.read.parquet(f"{tmp_path}/model"))
    fresh = wide(spark, correlated(9, 50))
    assert filled(chained.impute_chained(fresh, model)) == pytest.approx(filled(chained.impute_chained(fresh, again)))


def test_imputations(spark):
    x = correlated()
    df = wide(spark, x)
    model = chained.fit_chained(df, V)
    same = chained.impute_chained(df, model, 3)
    assert same.count() == 3 * len(x)
    assert filled(chained.mean_imputation(same, V)) == pytest.approx(filled(chained.impute_chained(df, model)))
    drawn = chained.impute_chained(df, model, 3, posterior=True, seed=1)
    spread = drawn.groupBy("t").agg(F.stddev("b").alias("sd"), F.max(F.lit(1)).alias("one"))
    missing = {i for i in range(len(x)) if np.isnan(x[i, 1])}
    assert {r.t for r in spread.where("sd > 1e-12").collect()} == missing
    repeat = chained.impute_chained(df.repartition(5), model, 3, posterior=True, seed=1)
    assert filled(drawn.where("imputation = 2")) == pytest.approx(filled(repeat.where("imputation = 2")))


def test_forest_keeps_observed_cells(spark):
    x = correlated(2, 150)
    got = filled(chained.forest_chained(wide(spark, x), V, rounds=1, trees=3, depth=4))
    assert np.array_equal(got[~np.isnan(x)], x[~np.isnan(x)]) and not np.isnan(got).any()


def test_forest_is_fitted_apart_saved_and_loaded(spark, tmp_path):
    model = chained.fit_forest(wide(spark, correlated(2, 120)), V, rounds=2, trees=3, depth=4)
    fresh = wide(spark, correlated(9, 60))
    model.save(spark, f"{tmp_path}/forest")
    again = chained.ForestModel.load(spark, f"{tmp_path}/forest")
    assert filled(model.impute(fresh)) == pytest.approx(filled(again.impute(fresh)))


def test_any_number_of_variables(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 1)) + 0.1 * rng.normal(size=(200, 20))
    for i in range(40):
        x[i, [i % 20, (i + 7) % 20]] = np.nan
    names = [f"v{i}" for i in range(20)]
    df = spark.createDataFrame([("a", t, *[None if np.isnan(c) else float(c) for c in row]) for t, row in enumerate(x)], ["station_id", "t", *names])
    model = chained.fit_chained(df, names, rounds=2, predictor="linear", tolerance=0)
    done = chained.impute_chained(df, model)
    assert done.count() == 200 and done.where(" or ".join(f"{n} is null" for n in names)).count() == 0


def test_residuals_of_one_row_go_together(spark):
    """Two variables that are nearly equal stay so when both are drawn."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    x = np.stack((a, a + 0.01 * rng.normal(size=400), rng.normal(size=400)), axis=1)
    x[:150, :2] = np.nan
    df = wide(spark, x)
    model = chained.fit_chained(df, V, rounds=3, predictor="linear", tolerance=0)
    drawn = chained.impute_chained(df, model, 2, posterior=True, seed=1).where("t < 150")
    row = drawn.select(F.corr("a", "b").alias("r"), F.stddev("a").alias("s")).first()
    assert row.r > 0.9 and row.s > 0.001


def test_chained_limits(spark):
    df = wide(spark, np.array([[1.0, np.nan, 2.0], [2.0, np.nan, 3.0]]))
    with pytest.raises(ValueError, match="no observed value"):
        chained.fit_chained(df, V)
    with pytest.raises(ValueError):
        chained.fit_chained(df, ("a",))
    with pytest.raises(ValueError):
        chained.fit_chained(df, V, predictor="forest")


# --- metrics ------------------------------------------------------------------

CELLS = "station_id string, variable string, ts string, truth double, estimate double, is_eval boolean, gap_length int"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELLS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_metrics_by_hand(spark):
    df = cells(
        spark,
        [
            ("a", "x", "2023-01-01", 1.0, 2.0, True, 3),
            ("a", "x", "2023-04-01", 2.0, 2.0, True, 6),
            ("a", "y", "2023-07-01", 3.0, 1.0, True, 168),
            ("a", "y", "2023-12-31", 9.0, 0.0, False, 24),
        ],
    )
    r = score.all_metrics(df).first()
    assert (r.rmse, r.mae, r.mse, r.bias, r.n) == (pytest.approx(math.sqrt(5 / 3)), 1.0, pytest.approx(5 / 3), pytest.approx(-1 / 3), 3)
    assert r.r2 == pytest.approx(1 - 5 / 2)
    assert {r.stratum for r in score.by_gap_length(df).collect()} == {"1-6h", "6-24h", ">168h"}
    assert {r.stratum: r.n for r in score.by_season(df).collect()} == {"winter": 1, "spring": 1, "summer": 1}
    assert {r.stratum: r.r2 for r in score.by_variable(df).collect()}["y"] is None
    assert {r.stratum for r in score.by_extremes(df).collect()} == {"extreme_low", "normal", "extreme_high"}
    every = score.stratified_metrics(df).collect()
    assert sum(r.n for r in every) == 12
    none = score.all_metrics(df.where("not is_eval")).first()
    assert none.rmse is None and none.r2 is None and none.n == 0
    with pytest.raises(ValueError):
        score.stratified_metrics(df, ("colour",))
    with pytest.raises(ValueError):
        score.by_extremes(df, (95, 5))


def errors(spark, a, b, key="all"):
    rows = [(key, f"s{i % 5}", x, y) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "k string, station_id string, err_a double, err_b double")


def test_paired_tests(spark):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(0, 1, 80), 1), np.round(rng.normal(0.4, 1.5, 80), 1)
    df = errors(spark, a.tolist() + [None], b.tolist() + [1.0])
    d = a - b
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))

    t = significance.paired_t_test(df, ["k"]).first()
    stat = d.mean() / (d.std(ddof=1) / math.sqrt(80))
    assert t.n == 80 and t.statistic == pytest.approx(stat) and t.p_value == pytest.approx(tail(stat))
    assert t.effect_size == pytest.approx(d.mean() / d.std(ddof=1)) and t.significant == (tail(stat) < 0.05)

    loss = a**2 - b**2
    dm = significance.diebold_mariano_test(df, ["k"]).first()
    assert dm.statistic == pytest.approx(loss.mean() / math.sqrt(loss.var(ddof=1) / 80)) and dm.interpretation.startswith("A has")

    w = significance.wilcoxon_signed_rank_test(df, ["k"]).first()
    e = np.round(d[np.round(d, 9) != 0], 9)
    size = np.abs(e)
    rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    assert w.n == len(e)
    # Differences of one-decimal numbers may tie only up to rounding noise.
    assert w.w_plus + w.w_minus == pytest.approx(len(e) * (len(e) + 1) / 2)
    assert w.w_plus == pytest.approx(rank[e > 0].sum(), rel=0.02)


def test_paired_tests_without_evidence(spark):
    same = errors(spark, [1.0, 2.0], [1.0, 2.0])
    t = significance.paired_t_test(same, ["k"]).first()
    assert t.statistic is None and t.p_value == 1.0 and not t.significant
    one = significance.diebold_mariano_test(errors(spark, [1.0], [2.0]), ["k"]).first()
    assert one.statistic is None and one.p_value == 1.0
    few = significance.paired_t_test(errors(spark, [1.0, 2.0, 4.0], [0.0, 0.0, 1.0]), ["k"]).first()
    assert few.statistic is not None and few.p_value is None and not few.significant
    with pytest.raises(ValueError):
        significance.diebold_mariano_test(same, ["k"], loss="cubic")


def test_normal_tail(spark):
    values = [0.0, 1e-9, -0.3, 1.0, 1.959963985, -3.5, 3.6, 5.0, 8.0, 20.0, 40.0, None]
    rows = spark.createDataFrame([(z,) for z in values], "z double").select("z", significance.normal_tail("z").alias("p")).collect()
    for r in rows:
        assert r.p is None if r.z is None else r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9, abs=1e-300)


def test_bonferroni_and_bootstrap(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.4), ("c", None)], "k string, p_value double")
    got = {r.k: (r.p_adjusted, r.significant_adjusted) for r in significance.bonferroni(tests).collect()}
    assert got == {"a": (0.02, True), "b": (0.8, False), "c": (None, False)}
    rng = np.random.default_rng(5)
    df = errors(spark, rng.normal(0.2, 1, 500).tolist(), [0.0] * 500).withColumn("station_id", F.monotonically_increasing_id().cast("string"))
    r = significance.bootstrap_intervals(df, ["k"], replicas=300).first()
    assert r.replicas == 300 and r.rmse_low < 1.02 < r.rmse_high and r.bias_low < 0.2 < r.bias_high
    assert r.bias_high - r.bias_low == pytest.approx(2 * 1.96 / math.sqrt(500), rel=0.25)


def test_poisson_weights():
    drawn = np.concatenate([significance.replica_weights(1, f"s{i}", 1000) for i in range(20)])
    assert drawn.mean() == pytest.approx(1, abs=0.03) and drawn.var() == pytest.approx(1, abs=0.05)
    assert (significance.replica_weights(1, "s3", 1000) == drawn[3000:4000]).all()


def test_ensemble_scores(spark):
    rng = np.random.default_rng(6)
    samples, truth = rng.normal(size=(40, 9)), rng.normal(size=40)
    rows = [("x", float(y), True, [float(v) for v in s]) for y, s in zip(truth, samples)]
    df = spark.createDataFrame(rows, "variable string, truth double, is_eval boolean, samples array<double>")
    expected = np.mean([np.abs(s - y).mean() - 0.5 * np.abs(s[:, None] - s).mean() for y, s in zip(truth, samples)])
    assert ensembles.mean_crps(df).first().crps == pytest.approx(expected)
    got = {r.level: (r.coverage, r.mean_width) for r in ensembles.interval_coverage(df).collect()}
    for level in (0.5, 0.9, 0.95):
        low, high = np.quantile(samples, [(1 - level) / 2, (1 + level) / 2], axis=1)
        assert got[level] == (pytest.approx(np.mean((truth >= low) & (truth <= high))), pytest.approx((high - low).mean()))


def test_spells(spark):
    highs = [36, 37, 38, 20, 36, 36, 20, 36, 36, 36, 36]
    rows = [("a", f"2020-07-{i + 1:02d} 12:00", float(h), 0.0) for i, h in enumerate(highs)]
    df = spark.createDataFrame(rows, "station_id string, ts string, truth double, estimate double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.source, r.kind, str(r.start), r.n_days) for r in downstream.extreme_spells(df).collect()}
    assert got == {("truth", "heat", "2020-07-01", 3), ("truth", "heat", "2020-07-08", 4)}
    days = {r.source: r for r in downstream.degree_days(df).collect()}
    assert days["truth"].cooling == pytest.approx(sum(h - 18 for h in highs)) and days["estimate"].heating == pytest.approx(18 * 11)


# --- end to end ---------------------------------------------------------------


def smooth_panel(spark):
    df = spark.range(5 * 200).selectExpr("cast(id % 5 as string) station_id", "cast(id div 5 as int) t")
    x = F.sin(F.col("t") / 12.0) * 10
    named = F.inline(F.array(F.struct(F.lit("x").alias("variable"), x.alias("value")), F.struct(F.lit("y").alias("variable"), (x * 2 + 1).alias("value"))))
    ts = F.timestamp_add("HOUR", F.col("t"), F.lit("2023-01-01").cast("timestamp_ntz"))
    return df.select("station_id", "t", ts.alias("ts"), named)


def test_evaluate_ranks_the_methods(spark):
    panel = smooth_panel(spark)
    spec = masks.MaskSpec("mcar", 0.2, 1, 8)
    rmse = {}
    for method in ("linear", "carry_forward", "akima", "chained", "chained_linear"):
        table = plan.evaluate(panel, ("x", "y"), spec, method)
        overall = table.where("stratification = 'overall'").first()
        assert overall.n == 5 * int(0.2 * 200 * 2)
        rmse[method] = overall.rmse
    assert rmse["akima"] < rmse["linear"] < rmse["carry_forward"]
    with pytest.raises(ValueError):
        plan.evaluate(panel, ("x", "y"), spec, "guess")


@pytest.mark.parametrize("name,options", [("linear", {}), ("akima", {"max_gap": 5}), ("chained_linear", {"rounds": 2, "tolerance": 0}), ("chained_forest", {"rounds": 1, "trees": 2, "depth": 3})])
def test_imputers_fit_save_load_and_impute(spark, tmp_path, name, options):
    panel = smooth_panel(spark).withColumn("value", F.when(F.col("t") % 7 != 3, F.col("value"))).where("t < 60").select("station_id", "t", "variable", "value")
    imputer = imputers.IMPUTERS[name](**options).fit(panel, ("x", "y"))
    imputer.save(spark, f"{tmp_path}/{name}")
    again = type(imputer).load(spark, f"{tmp_path}/{name}")
    key = lambda df: {(r.station_id, r.t, r.variable): r.filled for r in df.collect()}
    got = key(imputer.impute(panel))
    assert len(got) == panel.count() and None not in got.values()
    assert key(again.impute(panel)) == pytest.approx(got)


def test_hidden_values_are_not_seen(spark):
    """Changing what is hidden must not change the estimates."""
    panel = smooth_panel(spark)
    spec = masks.MaskSpec("mcar", 0.3, 1, 8)
    hidden = plan.hide(panel, ("x", "y"), spec, 5)
    spoiled = hidden.withColumn("truth", F.when(F.col("is_eval"), -999.0).otherwise(F.col("truth")))
    keys = ["station_id", "t", "variable"]
    first, second = (plan.estimate(h, {"e": "linear", "c": "akima"}, ("x", "y")).select(*keys, "e", "c") for h in (hidden, spoiled))
    assert first.exceptAll(second).count() == 0 and first.where("e = -999").count() == 0


def test_no_plan_has_a_cartesian_product_of_data(spark):
    done = plan.evaluate(smooth_panel(spark), ("x", "y"), masks.MaskSpec("mar", 0.2, 1, 6, condition_variable="x"))
    text = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
