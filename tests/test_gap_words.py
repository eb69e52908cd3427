"""Gap statistics and cells under masks go through words of steps, not through cells."""

import random
from statistics import median

from pyspark.sql import functions as F

from stationfill.operators import masks, series

KIND = "station_id string, variable string, t int, value double"


def irregular(seed):
    """Series with steps left out, negative steps, long gaps, ends without values, and rows without a key or a step."""
    draw, rows = random.Random(seed), []
    for s in ("a", "b", "c", None):
        for v in ("x", "y"):
            low, high, thin = draw.randint(-300, 10), draw.randint(200, 500), draw.choice((0.0, 0.0, 0.2))
            present, lasting = True, 0
            for t in range(low, high):
                if lasting == 0:
                    present, lasting = draw.random() < 0.5, draw.choice((1, 2, 3, 62, 61, 63, 130))
                lasting -= 1
                if draw.random() >= thin:
                    rows.append((s, v, t, 1.0 if present else None))
    rows += [("d", "x", t, None) for t in range(55, 70)] + [("e", "x", 61, 2.0), ("e", "x", 62, None), ("e", "y", 7, 1.0)]
    return rows + [("a", "x", None, None), ("b", None, 3, None), ("a", "x", None, 1.0)]


def expected(rows, by):
    told = {}
    for s, v, t, x in rows:
        entry = told.setdefault(tuple({"station_id": s, "variable": v}[c] for c in by), [0, 0, []])
        entry[0] += 1
        entry[1] += x is None
    for s, v in {(s, v) for s, v, *_ in rows if s is not None and v is not None}:
        cells = {t: x for a, b, t, x in rows if (a, b) == (s, v) and t is not None}
        seen = sorted(t for t, x in cells.items() if x is not None)
        for t in sorted(cells):
            before, after = [u for u in seen if u < t], [u for u in seen if u > t]
            start = before[-1] + 1 if before else min(cells)
            if cells[t] is None and t == start:
                told[tuple({"station_id": s, "variable": v}[c] for c in by)][2].append((after[0] - 1 if after else max(cells)) - start + 1)
    return {k: (n, m, len(g), sum(g) / len(g) if g else None, median(g) if g else None, max(g, default=None)) for k, (n, m, g) in told.items()}


def test_gap_statistics_of_irregular_series(spark):
    for seed in (1, 2):
        rows = irregular(seed)
        df = spark.createDataFrame(rows, KIND).repartition(3)
        for by in (["station_id", "variable"], ["variable"], []):
            got = {
                tuple(r[c] for c in by): (r.n_cells, r.n_missing, r.n_gaps, r.mean_length, r.median_length, r.max_length)
                for r in series.gap_statistics(df, series.SERIES, by).collect()
            }
            assert got == expected(rows, by)


def test_groups_that_cut_through_series(spark):
    df = spark.createDataFrame([("a", "x", t, None if t % 5 else 1.0) for t in range(40)], KIND).withColumn("half", F.col("t") < 20)
    got = {r.half: (r.n_cells, r.n_missing, r.n_gaps, r.max_length) for r in series.gap_statistics(df, series.SERIES, ["half"]).collect()}
    assert got == {True: (20, 16, 4, 4), False: (20, 16, 4, 4)}


def test_cells_under_masks(spark):
    cells = [(s, t, v) for s in ("a", None) for v in ("x", "y") for t in range(-70, 140) if t % 9]
    draw = random.Random(3)
    drawn = {name: draw.sample(cells, 60) + [("a", 500, "x"), ("z", 1, "x")] for name in ("m", "n")}
    kind = "station_id string, t int, variable string"
    tables = {name: spark.createDataFrame([x for x in told if x[0]], kind) for name, told in drawn.items()}
    out = masks.cells_under_masks(spark.createDataFrame(cells, kind), tables)
    assert out.dtypes == [("strategy", "string"), ("station_id", "string"), ("variable", "string"), ("t", "int"), ("hidden", "boolean")]
    got = sorted(map(str, out.collect()))
    rows = [(n, s, v, t, s is not None and (s, t, v) in set(drawn[n])) for n in drawn for s, t, v in cells]
    assert got == sorted(map(str, spark.createDataFrame(rows, out.schema).collect()))


def sent(df):
    """Rows that shuffles have written once ``df`` has been collected."""
    total, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        if name == "ShuffleExchangeExec":
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        left += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_cells_are_not_shuffled(spark):
    steps = spark.range(20_000, numPartitions=2)
    panel = steps.select(F.lit("a").alias("station_id"), F.lit("x").alias("variable"), F.col("id").cast("int").alias("t"), F.when(F.col("id") % 7 != 0, 1.0).alias("value"))
    stats = series.gap_statistics(panel)
    assert [(r.n_cells, r.n_gaps) for r in stats.collect()] == [(20_000, 2858)]
    assert sent(stats) < 2_000
