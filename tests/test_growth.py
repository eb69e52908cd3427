"""What must not grow: plans, shuffles and single tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationfill.functions.draws import standard_normal
from stationfill.operators import chained, chained_sets, fill, masks, scale, series, significance


def panel(spark, n=3000):
    return spark.range(n).selectExpr(
        "cast(id % 7 as string) station_id", "'x' variable", "cast(id div 7 as int) t", "if(id % 3 = 0, null, cast(id * id % 17 as double)) value", "'more' ts"
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["akima_fill", "linear_fill"])
def test_the_shuffle_is_shared_whatever_columns_are_read_later(spark, name):
    done = getattr(fill, name)(panel(spark)).select("station_id", "variable", "t", "filled")
    done.collect()
    text = plan_of(done)
    assert text.count("ReusedExchange") == 1 and text.count("Range (0") == 1


def test_one_window_finds_all_neighbours(spark):
    rows = series.nearest_points(panel(spark), series.SERIES, {"v": (F.col("value"), 3)}, width=5000)
    logical = rows._jdf.queryExecution().optimizedPlan().toString()
    by_step = [line for line in logical.splitlines() if "Window" in line and "lag(" in line]
    assert len(by_step) == 1 and "lead(" in by_step[0]


def test_a_test_on_akima_errors_has_a_short_plan(spark):
    filled = fill.akima_fill(panel(spark))
    pairs = filled.select("station_id", "variable", (F.col("filled") - 1.0).alias("err_a"), F.round(F.col("filled") - F.col("t") + 1e-9, 4).alias("err_b"))
    sized = significance._pairs(pairs).where(F.col("err_a") - F.col("err_b") != 0).groupBy("variable").agg(F.avg(F.abs(F.col("err_a") - F.col("err_b"))))
    assert len(sized._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_sweeps_are_spread_where_ids_come_out_of_a_shuffle(spark):
    samples = panel(spark, 70_000).groupBy("station_id").agg(F.min("t").alias("first_t"), F.lit(50).cast("bigint").alias("n_steps"))
    runs = masks.synthetic_runs(samples, ("x",), masks.MaskSpec("mcar", 0.2, 1, 12), 3)
    tasks = runs.select("station_id", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.station_id for r in tasks}) == 7 and len({r.p for r in tasks}) > 1


def test_runs_do_not_depend_on_how_many_are_handed_on_at_a_time(spark, monkeypatch):
    samples = spark.createDataFrame([(i, 5 * i, 60) for i in range(9)], "station_id bigint, first_t int, n_steps bigint")
    spec = masks.MaskSpec("mcar", 0.3, 1, 6)
    runs = lambda: sorted(map(tuple, masks.synthetic_runs(samples, ("x", "y"), spec, 1).collect()))
    whole = runs()
    cells = {(s, v, t) for s, v, first, last, _ in whole for t in range(first, last + 1)}
    assert len(cells) == sum(last - first + 1 for _, _, first, last, _ in whole) == 9 * int(0.3 * 60 * 2)
    assert all(5 * s <= first <= last < 5 * s + 60 for s, _, first, last, _ in whole)
    table = masks._run_table([(4, 10, np.array([[0, 1, 2, 3]])), (6, 20, np.array([[0, 0, 1, 1], [1, 1, 5, 6]]))])
    assert table.values.tolist() == [[4, 1, 12, 13, 0], [6, 0, 21, 21, 0], [6, 1, 25, 26, 1]]


def test_only_missing_cells_are_drawn_and_as_the_functions_draw_them(spark):
    missing = np.array([[True, False], [False, False], [True, True]])
    got = chained_sets._normals(7, ["a", None, "b"], [3, 4, 5], 2, ["x", "y"], missing)
    rows = spark.createDataFrame([("a", 3, 0), (None, 4, 1), ("b", 5, 2)], "s string, t int, row int").crossJoin(spark.range(2).withColumnRenamed("id", "m"))
    draws = [standard_normal(F.lit("7"), F.col("m"), F.col("s"), F.col("t"), v).alias(v) for v in ("x", "y")]
    for r in rows.select("row", "m", *draws).collect():
        for c, v in enumerate(("x", "y")):
            assert got[r["row"], r["m"], c] == (pytest.approx(r[v], abs=1e-12) if missing[r["row"], c] else 0.0)


def test_a_forest_completes_its_own_table_without_a_second_replay(spark, monkeypatch):
    rows = [("a", t, float(t), None if t % 3 == 0 else 2.0 * t) for t in range(60)]
    wide = spark.createDataFrame(rows, "station_id string, t int, x double, y double")
    key = lambda df: {r.t: (r.x, r.y) for r in df.collect()}
    replayed = key(chained.fit_forest(wide, ("x", "y"), 2, 3, 3).impute(wide))
    monkeypatch.setattr(chained.ForestModel, "impute", None)
    assert key(chained.forest_chained(wide, ("x", "y"), 2, 3, 3)) == replayed


def test_the_panel_is_not_shuffled_by_variable_for_its_scale(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(scale.normalize_variables(panel(spark).withColumn("variable", F.expr("if(t % 2 = 0, 'x', 'y')")), "minmax")[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
