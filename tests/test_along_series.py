"""Everything that looks along a series, against plain Python on one series at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.operators import fill, series
from stationfill.operators.blocks import explode_range, nearest_points, running_sum, with_bounds

PANEL = "station_id string, variable string, t int, value double"


def panel(spark, cells):
    """``cells``: {(station, variable): {t: value}}."""
    rows = [(s, v, t, x) for (s, v), points in cells.items() for t, x in points.items()]
    return spark.createDataFrame(rows, PANEL)


def random_cells(seed, lengths, share=0.6):
    rng = np.random.default_rng(seed)
    cells = {}
    for i, n in enumerate(lengths):
        values = [float(x) if rng.random() < share else None for x in rng.normal(size=n)]
        cells[(f"s{i}", "x")] = dict(zip(range(-7, n - 7), values))
    cells[("empty", "x")] = {t: None for t in range(9)}
    return cells


def by_series(rows, *columns):
    out = {}
    for r in rows:
        out.setdefault((r.station_id, r.variable), {})[r.t] = tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
    return out


@pytest.mark.parametrize("width", [1, 3, 8, 4096])
def test_nearest_points_do_not_depend_on_block_width(spark, width):
    cells = random_cells(3, [40, 17, 1], share=0.3)
    names = [f"p_{side}{part}{i}" for side in "ba" for i in (1, 2, 3) for part in "tv"]
    found = nearest_points(panel(spark, cells), series.SERIES, {"p": (F.col("value"), 3)}, bounds=True, width=width)
    got = by_series(found.collect(), *names, "first_t", "last_t")
    for key, points in cells.items():
        seen = [(t, v) for t, v in points.items() if v is not None]
        for t in points:
            before = [p for p in reversed(seen) if p[0] < t][:3] + [(None, None)] * 3
            after = [p for p in seen if p[0] > t][:3] + [(None, None)] * 3
            expected = [x for p in before[:3] + after[:3] for x in p] + [min(points), max(points)]
            assert list(got[key][t]) == expected


def test_two_point_kinds_share_one_pass(spark):
    df = panel(spark, {("a", "x"): {0: 1.0, 1: None, 2: 3.0, 3: None}})
    odd = F.when(F.col("t") % 2 == 1, F.col("t"))
    got = nearest_points(df, series.SERIES, {"v": (F.col("value"), 1), "odd": (odd, 1)}).orderBy("t").collect()
    assert [(r.v_bt1, r.odd_at1) for r in got] == [(None, 1), (0, 3), (0, 3), (2, None)]


@pytest.mark.parametrize("width", [2, 4096])
def test_running_sum_and_bounds(spark, width):
    cells = random_cells(5, [25, 9])
    df = panel(spark, cells)
    flag = F.when(F.col("value") > 0, 1)
    sums = by_series(running_sum(df, series.SERIES, flag, width=width).collect(), "position", "position_total")
    ends = by_series(with_bounds(df, series.SERIES, width=width).collect(), "first_t", "last_t")
    for key, points in cells.items():
        total = 0
        for t, v in points.items():
            total += v is not None and v > 0
            assert sums[key][t][0] == total and ends[key][t] == (min(points), max(points))
        assert {p[1] for p in sums[key].values()} == {total}


def test_explode_range(spark):
    df = spark.createDataFrame([("a", -3, 12), ("b", 5, 5), ("none", 2, 1)], "k string, lo int, hi int")
    got = explode_range(df, ["k"], F.col("lo"), F.col("hi"), width=4).groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("t"))
    assert {r.k: r.t for r in got.collect()} == {"a": list(range(-3, 13)), "b": [5]}


def straight(points, max_gap=None):
    seen = [t for t, v in points.items() if v is not None]
    out = {}
    for t, v in points.items():
        left, right = [s for s in seen if s < t], [s for s in seen if s > t]
        if v is not None:
            out[t] = v
        elif not seen:
            out[t] = 0.0
        elif not left:
            out[t] = points[right[0]]
        elif not right:
            out[t] = points[left[-1]]
        else:
            a, b = left[-1], right[0]
            inside = points[a] + (points[b] - points[a]) * (t - a) / (b - a)
            out[t] = None if max_gap is not None and b - a - 1 > max_gap else inside
    return out


@pytest.mark.parametrize("max_gap", [None, 2])
def test_linear_fill(spark, max_gap):
    cells = random_cells(7, [60, 5], share=0.4)
    got = by_series(fill.linear_fill(panel(spark, cells), max_gap).collect(), "filled")
    for key, points in cells.items():
        for t, expected in straight(points, max_gap).items():
            assert got[key][t] == (None if expected is None else pytest.approx(expected))


def test_gap_longer_than_a_block(spark):
    """Blocks without any observed cell still get what lies around them."""
    points = {t: None for t in range(13_000)}
    points[10], points[12_990] = 0.0, 12_980.0
    got = by_series(fill.linear_fill(panel(spark, {("long", "x"): points})).where("t % 500 = 0").collect(), "filled")[("long", "x")]
    assert got[0] == 0.0 and got[6_000] == pytest.approx(5_990.0) and got[12_500] == pytest.approx(12_490.0)
    runs = {(r.start_t, r.length) for r in series.gap_runs(panel(spark, {("long", "x"): points})).collect()}
    assert runs == {(0, 10), (11, 12_979), (12_991, 9)}


def akima(x, y, at):
    """Akima (1970) by its formula, in numpy."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    m = np.empty(n + 3)
    m[2:-2] = np.diff(y) / np.diff(x)
    m[1] = 2 * m[2] - m[3] if n > 2 else m[2]
    m[0] = 2 * m[1] - m[2]
    m[-2] = 2 * m[-3] - m[-4] if n > 2 else m[-3]
    m[-1] = 2 * m[-2] - m[-3]
    slopes = []
    for i in range(n):
        a, b = abs(m[i + 3] - m[i + 2]), abs(m[i + 1] - m[i])
        slopes.append((a * m[i + 1] + b * m[i + 2]) / (a + b) if a + b > 1e-12 else (m[i + 1] + m[i + 2]) / 2)
    i = max(j for j in range(n - 1) if x[j] <= at)
    h = x[i + 1] - x[i]
    s = (at - x[i]) / h
    return (
        (2 * s**3 - 3 * s**2 + 1) * y[i] + (s**3 - 2 * s**2 + s) * h * slopes[i] + (3 * s**2 - 2 * s**3) * y[i + 1] + (s**3 - s**2) * h * slopes[i + 1]
    )


def test_akima_fill(spark):
    cells = random_cells(11, [70, 30, 12], share=0.5)
    cells[("two", "x")] = {0: None, 1: 1.0, 2: None, 3: 5.0, 4: None}
    cells[("one", "x")] = {0: None, 1: 4.0, 2: None}
    got = by_series(fill.akima_fill(panel(spark, cells)).collect(), "filled")
    for key, points in cells.items():
        seen = [t for t, v in points.items() if v is not None]
        for t, expected in straight(points).items():
            if points[t] is None and len(seen) > 1 and seen[0] < t < seen[-1]:
                expected = akima(seen, [points[s] for s in seen], t)
            assert got[key][t] == pytest.approx(expected, abs=1e-9)


def test_gap_rules_by_hand(spark):
    df = panel(spark, {("a", "x"): dict(enumerate([1.0, None, 3.0, None, None, None, 7.0])), ("b", "x"): dict(enumerate([1.0, None, None, 4.0, None]))})
    got = by_series(fill.linear_fill(df, 2).collect(), "filled")
    assert list(got[("a", "x")].values()) != [] and [got[("a", "x")][t] for t in range(7)] == [1, 2, 3, None, None, None, 7]
    assert [got[("b", "x")][t] for t in range(5)] == pytest.approx([1, 2, 3, 4, 4])
    lengths = by_series(series.gap_lengths(df).collect(), "gap_length")
    assert [lengths[("a", "x")][t] for t in range(7)] == [0, 1, 0, 3, 3, 3, 0]
    stats = {r.station_id: r for r in series.gap_statistics(df).collect()}
    assert stats["a"].n_gaps == 2 and stats["a"].mean_length == 2.0 and stats["a"].median_length == 2.0 and stats["a"].max_length == 3
    categories = {r.category: (r.n_gaps, r.total_hours) for r in series.gap_categories(series.gap_runs(df)).collect()}
    assert categories == {"short": (4, 7)}


def test_grid_keeps_the_first_report_of_a_step(spark):
    reports = spark.createDataFrame(
        [("a", 1, "2020-01-01 00:10", None, 1.0), ("a", 1, "2020-01-01 00:20", 5.0, 2.0), ("a", 1, "2020-01-01 00:30", 6.0, 3.0), ("a", 3, "2020-01-01 02:00", 7.0, None)],
        "station_id string, t int, ts string, x double, y double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    grid = series.regular_grid(series.first_per_step(reports, ["x", "y"]), ["x", "y"])
    got = {(r.variable, r.t): r.value for r in grid.collect()}
    assert got == {("x", 1): 5.0, ("y", 1): 1.0, ("x", 2): None, ("y", 2): None, ("x", 3): 7.0, ("y", 3): None}


def test_window_counts(spark):
    df = panel(spark, {("a", "x"): {t: float(t) for t in range(5, 105)}})
    cut = series.sliding_windows(df, 24, 10)
    starts = {r.window_start: r.n for r in cut.groupBy("window_start").agg(F.count("*").alias("n")).collect()}
    assert len(starts) == (100 - 24) // 10 + 1 and set(starts.values()) == {24} and min(starts) == 5
    assert cut.where(F.col("t") - F.col("window_start") != F.col("pos")).count() == 0
    assert series.sliding_windows(df, 101, 1).count() == 0
    packed = series.packed_windows(cut).first()
    assert [c.pos for c in packed.cells] == list(range(24))
    with pytest.raises(ValueError):
        series.sliding_windows(df, 0, 1)


def test_temporal_segments(spark):
    df = panel(spark, {("a", "x"): {t: 0.0 for t in range(10)}})
    got = by_series(series.temporal_segments(df, 0.6, 0.2, 0.2).collect(), "segment")[("a", "x")]
    assert [got[t] for t in range(10)] == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    with pytest.raises(ValueError):
        series.temporal_segments(df, 0.5, 0.2, 0.2)
    with pytest.raises(ValueError):
        series.take_segment(df, "all")


def test_one_shuffle_is_shared(spark):
    """Rows are computed once, although the summary reads them too."""
    df = spark.range(20_000).selectExpr("cast(id % 7 as string) station_id", "'x' variable", "cast(id div 7 as int) t", "cast(id as double) value")
    done = fill.linear_fill(df)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Range (0") == 1
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_no_row_is_lost_whatever_readers_see(spark, reuse):
    """Both readers of the shuffle may see different values: rows in are rows out all the same."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(1000).selectExpr("'a' station_id", "'x' variable", "cast(id as int) t", "if(id % 3 = 0, null, rand()) value")
        assert fill.linear_fill(df).count() == 1000
        assert series.gap_lengths(df).count() == 1000
        assert running_sum(df, series.SERIES, F.lit(1), width=7).count() == 1000
        assert nearest_points(df, series.SERIES, {"v": (F.col("value"), 3)}, bounds=True, width=7).count() == 1000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_rows_with_null_keys_come_through(spark):
    rows = [("a", "x", 0, 1.0), ("a", "x", 1, None), ("a", "x", 2, 3.0), (None, "x", 0, 1.0), (None, "x", 1, None), ("a", None, 1, None), ("a", "x", None, 5.0)]
    df = spark.createDataFrame(rows, PANEL)
    filled = fill.linear_fill(df).collect()
    assert len(filled) == len(rows)
    assert sorted((str(r.station_id), r.filled) for r in filled if r.t == 1 and r.variable) == [("None", 0.0), ("a", 2.0)]
    sums = running_sum(df, series.SERIES, F.lit(1)).collect()
    assert sorted((r.t, r.position) for r in sums if r.station_id and r.variable and r.t is not None) == [(0, 1), (1, 2), (2, 3)]
    assert all(r.position is None for r in sums if r.station_id is None or r.variable is None or r.t is None)
    assert with_bounds(df, series.SERIES).count() == len(rows)
