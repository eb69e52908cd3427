"""Station table, ranks, splits, masks, scales."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationfill.functions import circular
from stationfill.operators import cluster, masks, metadata, ranks, scale, splits, stations

COLUMNS = "station_id string, latitude double, longitude double, total_observation_count int, last_observation string"


def station_table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("last_observation", F.col("last_observation").cast("timestamp_ntz"))


def crowded(seed, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lat, lon = rng.uniform(0, 0.06, 2)
        if i % 9 == 0:
            lat, lon = 0.02, 0.03  # many copies of one place
        last = None if i % 5 == 0 else f"2020-01-{1 + i % 7:02d}"
        rows.append((f"s{i:03d}", None if i == 3 else float(lat), float(lon), None if i % 11 == 0 else int(rng.integers(0, 9)), last))
    return rows


@pytest.mark.parametrize("strategy", stations.STRATEGIES)
@pytest.mark.parametrize("threshold", [0.01, 0.004])
def test_duplicates_against_all_pairs(spark, strategy, threshold):
    rows = crowded(1)

    def preference(r):
        if strategy == "prefer_longer":
            return (-(r[3] or 0), r[0])
        return (r[4] is None, tuple(-ord(c) for c in r[4] or ""), -(r[3] or 0) if r[4] is None else 0, r[0])

    expected, pairs = {}, 0
    for a in rows:
        near = [b for b in rows if None not in (a[1], b[1]) and abs(a[1] - b[1]) <= threshold and abs(a[2] - b[2]) <= threshold]
        pairs += sum(b[0] > a[0] for b in near)
        best = min(near, key=preference, default=a)
        if best[0] != a[0]:
            expected[a[0]] = best[0]
    table = station_table(spark, rows)
    found = stations.duplicate_stations(table, threshold, strategy)
    assert {r.station_id: r.duplicate_of for r in found.collect()} == expected
    assert stations.duplicate_pair_count(table, threshold).first()[0] == pairs
    kept = {r.station_id for r in stations.drop_duplicates(table, found).collect()}
    assert kept == {r[0] for r in rows} - set(expected)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        stations.duplicate_stations(station_table(spark, crowded(1)), strategy="combine")


def test_names(spark):
    df = spark.createDataFrame([("  fort-worth   MEACHAM\tfield ",), ("o'hare 4TH",), (None,), ("Clean Name",)], "n string")
    assert [r[0] for r in df.select(stations.clean_name(F.col("n"))).collect()] == ["Fort-Worth Meacham Field", "O'Hare 4Th", None, "Clean Name"]


def test_coordinates(spark):
    rows = [("ok", 10.0, 20.0, None), ("unknown", 10.0, 20.0, -999.9), ("high", 10.0, 20.0, 9001.0), ("lat", 91.0, 20.0, 0.0), ("none", None, None, 0.0)]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, elevation double")
    got = {r.station_id: (r.coord_valid, r.coord_reasons) for r in stations.check_coordinates(df).collect()}
    assert got["ok"] == (True, "") and got["unknown"] == (True, "")
    assert got["high"] == (False, "elevation out of range") and got["lat"] == (False, "latitude out of range")
    assert got["none"] == (False, "missing latitude, missing longitude")


def test_gap_analysis_rules(spark):
    rows = [("a", x) for x in ("2020-01-01 00:00", "2020-01-01 00:00", "2020-01-02 00:00", "2020-01-03 01:00", None)]
    rows += [("one", "2020-01-01 00:00"), ("none", None)]
    df = spark.createDataFrame(rows, "station_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r.station_id: r for r in metadata.gap_analysis(df).collect()}
    a = got["a"]
    assert (a.gap_count_24h, a.max_gap_hours, a.total_observations, a.expected_observations) == (1, 25.0, 5, 50)
    assert a.avg_interval_hours == pytest.approx(49 / 3)
    for key in ("one", "none"):
        assert tuple(got[key])[1:] == (0, 0.0, 0.0, 1, 0)


def test_histogram_of_constant_and_edges(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [(r.bin, r.n) for r in metadata.histogram(df, "x", 10).collect()] == [(0, 2)]
    edges = spark.createDataFrame([(1,), (2,), (4,), (5,)], "x int")
    assert {r.bin: r.n for r in metadata.edge_histogram(edges, "x", [1, 2, 4]).collect()} == {0: 1, 1: 2}


def test_circular(spark):
    df = spark.createDataFrame([(350.0,), (10.0,), (None,)], "d double")
    mean, std = df.select(circular.circular_mean(F.col("d")), circular.circular_std(F.col("d"))).first()
    assert min(mean, 360 - mean) == pytest.approx(0, abs=1e-9)
    assert std == pytest.approx(np.sqrt(-2 * np.log(np.cos(np.radians(10)))))
    even = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,)], "d double")
    assert even.select(circular.circular_std(F.col("d"))).first()[0] == pytest.approx(np.sqrt(-2 * np.log(1e-7)))
    turn = lambda a, b: spark.range(1).select(circular.angular_difference(F.lit(a), F.lit(b))).first()[0]
    assert turn(350.0, 10.0) == 20.0 and turn(10.0, 350.0) == -20.0 and turn(0.0, 180.0) == -180.0 and turn(180.0, 0.0) == -180.0


# --- ranks and quantiles ------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    x = np.round(np.random.default_rng(2).normal(size=6000) ** 3, 3)
    x[:2000] = 0.5
    return x, spark.createDataFrame([(str(i % 2), float(v)) for i, v in enumerate(x)], "g string, v double")


def test_exact_quantiles_by_brackets(spark, skewed):
    x, df = skewed
    p = [0.0, 0.05, 0.5, 0.95, 0.9993, 1.0]
    assert list(ranks.exact_quantiles(df, "v", p).first()) == pytest.approx(list(np.quantile(x, p)))
    assert list(ranks.exact_quantiles(df, "v", p).first()) == pytest.approx(list(np.quantile(x, p)))
    for r in ranks.exact_quantiles(df, "v", p, by="g").collect():
        assert list(r)[1:] == pytest.approx(list(np.quantile(x[int(r.g) :: 2], p)))


def test_tie_averaged_ranks(spark, skewed):
    x, df = skewed
    expected = pd.DataFrame({"g": [str(i % 2) for i in range(len(x))], "v": x})
    expected["r"] = expected.groupby("g").v.rank()
    got = ranks.tie_averaged_ranks(df, ["g"], "v", {"m": F.max("v")}).toPandas()
    merged = got.merge(expected.drop_duplicates(), on=["g", "v"])
    assert len(merged) == len(got) == len(expected.drop_duplicates()) and (merged.mean_rank == merged.r).all()


def test_shuffled_rank_and_splits(spark):
    ids = spark.range(500).select(F.col("id").cast("string").alias("station_id"))
    ranked = ranks.shuffled_rank(ids.union(ids), "station_id", 1)
    assert sorted(r.position for r in ranked.collect()) == list(range(1, 501))
    for strategy in ("spatial", "hybrid"):
        got = splits.create_split(strategy, ids)
        again = splits.create_split(strategy, ids.repartition(7))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in again.collect()}
        assert got.count() == got.select("station_id").distinct().count() == 500
    sizes = {r.split: r.n for r in splits.spatial_split(ids).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 350, "val": 75, "test": 75}
    other = splits.spatial_split(ids, seed=7)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in splits.spatial_split(ids).collect()}
    with pytest.raises(ValueError):
        splits.create_split("spatial", ids, 0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        splits.create_split("other", ids)
    with pytest.raises(ValueError):
        splits.create_split("temporal", ids)
    with pytest.raises(ValueError):
        splits.hybrid_split(ids, spatial_weight=1.5)


# --- masks --------------------------------------------------------------------

NAMES = ("x", "y", "z")


@pytest.fixture(scope="module")
def dense(spark):
    df = spark.range(6 * 168).selectExpr("cast(id % 6 as string) station_id", "cast(id div 6 as int) + 100 t")
    x = F.sin(F.col("t") / 9.0) + F.hash("t", "station_id") / 2.0**33
    return df.select("station_id", "t", F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), (x + i).alias("value")) for i, n in enumerate(NAMES)])))


SPECS = {
    "mcar": masks.MaskSpec("mcar", 0.2, 1, 24),
    "high": masks.MaskSpec("mcar", 0.8, 1, 24),
    "mar": masks.MaskSpec("mar", 0.2, 1, 6, condition_variable="x"),
    "mnar": masks.MaskSpec("mnar", 0.2, 1, 6, condition_variable="y"),
    "empirical": masks.MaskSpec("realistic", 0.2),
    "lognormal": masks.MaskSpec("realistic", 0.2, gap_distribution="lognormal"),
}


@pytest.mark.parametrize("name", SPECS)
def test_masks_reach_their_target_exactly(spark, dense, name):
    spec = SPECS[name]
    samples = masks.sample_sizes(dense)
    mask = masks.synthetic_mask(samples, NAMES, spec, 1, dense)
    totals = masks.mask_totals(samples, mask, 3, spec.missing_ratio).collect()
    assert len(totals) == 6 and all(r.masked == r.target == int(spec.missing_ratio * 168 * 3) for r in totals)
    assert mask.join(dense, ["station_id", "t", "variable"], "left_anti").count() == 0
    assert mask.count() == mask.select("station_id", "t", "variable").distinct().count()


@pytest.mark.parametrize(
    "spec",
    [
        masks.MaskSpec("mcar", 0.2),
        masks.MaskSpec("mcar", 0.95, 1, 24),
        masks.MaskSpec("mcar", 1.0, 1, 24),
        masks.MaskSpec("realistic", 0.5),
        masks.MaskSpec("mar", 0.5, 1, 24, condition_variable="x"),
        masks.MaskSpec("mnar", 0.9, condition_variable="y"),
    ],
)
def test_short_samples_reach_their_target(spark, dense, spec):
    short = dense.where("t < 100 + 24 + cast(station_id as int) * 12")
    samples = masks.sample_sizes(short)
    totals = masks.mask_totals(samples, masks.synthetic_mask(samples, NAMES, spec, 5, short), 3, spec.missing_ratio).collect()
    assert len(totals) == 6 and all(r.masked == r.target for r in totals)


def test_cells_without_candidates_end_the_rounds(spark):
    """Steps 0 and 9 are there, nothing between: gaps of one step can mask two steps and no more."""
    panel = spark.createDataFrame([("a", t, v, 1.0) for t in (0, 9) for v in NAMES], "station_id string, t int, variable string, value double")
    samples = masks.sample_sizes(panel)
    spec = masks.MaskSpec("mar", 0.9, 1, 1, condition_variable="x")
    assert masks.synthetic_mask(samples, NAMES, spec, 1, panel).count() == 6


def test_masks_do_not_depend_on_partitioning(spark, dense):
    spec = SPECS["mar"]
    draw = lambda panel, seed: {tuple(r) for r in masks.synthetic_mask(masks.sample_sizes(panel), NAMES, spec, seed, panel).collect()}
    first = draw(dense, 1)
    assert first == draw(dense.repartition(13), 1) and first != draw(dense, 2)


@pytest.mark.parametrize("name,variable", [("mar", "x"), ("mnar", "y")])
def test_biased_masks_prefer_extremes(spark, dense, name, variable):
    spec = SPECS[name]
    mask = masks.synthetic_mask(masks.sample_sizes(dense), NAMES, spec, 3, dense)
    one = dense.where(F.col("variable") == variable)
    q0, q1 = ranks.exact_quantiles(one, "value", [0.15, 0.85]).first()
    steps = one.select("station_id", "t", ((F.col("value") < q0) | (F.col("value") > q1)).alias("extreme"))
    share = mask.join(steps, ["station_id", "t"]).select(F.avg(F.col("extreme").cast("int"))).first()[0]
    assert share > 0.4  # 0.3 of all steps are extreme


def test_mask_limits(spark, dense):
    samples = masks.sample_sizes(dense)
    assert masks.synthetic_mask(samples, NAMES, masks.MaskSpec("mcar", 0.0), 1).count() == 0
    for bad in (
        dict(missing_ratio=1.5),
        dict(min_gap=0),
        dict(min_gap=5, max_gap=4),
        dict(kind="other"),
        dict(kind="mar"),
        dict(extreme_percentile=0.6),
        dict(gap_distribution="flat"),
    ):
        with pytest.raises(ValueError):
            masks.MaskSpec(**bad)
    with pytest.raises(ValueError):
        masks.synthetic_mask(samples, NAMES, masks.MaskSpec("mar", condition_variable="no"), 1, dense)
    with pytest.raises(ValueError):
        masks.synthetic_mask(samples, NAMES, SPECS["mar"], 1)


def test_applied_mask_hides_observed_cells_only(spark):
    panel = spark.createDataFrame([("a", 0, "x", 1.0), ("a", 1, "x", None), ("a", 2, "x", 3.0)], "station_id string, t int, variable string, value double")
    mask = spark.createDataFrame([("a", 0, "x", 0), ("a", 1, "x", 0)], "station_id string, t int, variable string, k int")
    got = masks.apply_mask(panel, mask).orderBy("t").collect()
    assert [(r.truth, r.value, r.is_synthetic, r.is_eval) for r in got] == [(1.0, None, True, True), (None, None, True, False), (3.0, 3.0, False, False)]


# --- scale, clusters ----------------------------------------------------------


def test_scale(spark):
    rows = [("a", "x", v) for v in (1.0, 3.0, None, 5.0)] + [("a", "flat", 2.0), ("a", "flat", 2.0)]
    df = spark.createDataFrame(rows, "station_id string, variable string, value double")
    stats = scale.fit_scale(df)
    got = {r.variable: r for r in stats.collect()}
    assert (got["x"].mean, got["x"].std, got["x"].n_observed) == (3.0, 2.0, 3)
    assert got["flat"].std == 1.0 and got["flat"].max_val == 3.0
    z = scale.scale(df, stats, "zscore", clip=0.5).where("variable = 'x'").collect()
    assert sorted(r.value for r in z if r.value is not None) == [-0.5, 0.0, 0.5] and sum(r.value is None for r in z) == 1
    for method in scale.METHODS:
        back = scale.unscale(scale.scale(df, stats, method), stats, method).where("variable = 'x' and value is not null")
        assert sorted(r.value for r in back.collect()) == pytest.approx([1.0, 3.0, 5.0])
    with pytest.raises(ValueError):
        scale.scale(df, stats, "log")
    empty = df.union(spark.createDataFrame([("a", "none", None)], df.schema))
    with pytest.raises(Exception, match="no observed value"):
        scale.fit_scale(empty).collect()


def test_clusters(spark):
    rows = [(f"s{i}", float(i % 3) * 10 + i / 1000, float(i % 3) * -5) for i in range(30)] + [("gap", None, 1.0)]
    df = spark.createDataFrame(rows, "station_id string, a double, b double")
    got = {r.station_id: r.cluster for r in cluster.cluster_stations(df, ["a", "b"], k=3, starts=3).collect()}
    assert got["gap"] is None and len({got[f"s{i}"] for i in range(30)}) == 3
    assert all(got[f"s{i}"] == got[f"s{i % 3}"] for i in range(30))
    with pytest.raises(ValueError):
        cluster.cluster_stations(df, ["a"])


def test_tasks_of_a_k_means_step_go_by_stations(spark, monkeypatch):
    seen, fit = [], cluster.KMeans.fit
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, rows: (seen.append(rows.rdd.getNumPartitions()), fit(self, rows))[1])
    near = lambda i: float(i % 3) * 10 + i / 1000
    df = spark.createDataFrame([(i, near(i), float(i % 3) * -5) for i in range(90)], "station_id int, a double, b double").repartition(40)
    got = {r.station_id: r.cluster for r in cluster.cluster_stations(df, ["a", "b"], k=3, starts=3).collect()}
    assert len(seen) == 3 and max(seen) <= spark.sparkContext.defaultParallelism
    assert len(got) == 90 and len(set(got.values())) == 3 and all(got[i] == got[i % 3] for i in range(90))
    seen.clear()
    monkeypatch.setattr(cluster, "ROWS_PER_TASK", 10)
    cluster.cluster_stations(df, ["a", "b"], k=3, starts=1)
    assert seen == [9]
    with pytest.raises(ValueError, match="fewer than 91"):
        cluster.cluster_stations(df, ["a", "b"], k=91)
