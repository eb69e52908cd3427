"""Scoring on hidden cells, paired tests, ensembles and climate indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import downstream, ensembles, score, significance
from ..plans import evaluate as plan
from ..session import checkpointed
from .fill_queries import AROUND, CURVE, LINE, MASKED, akima_sql, with_ends
from .registry import query
from .series_queries import EMPIRICAL, MCAR, SEED, mask_sql
from .views import OBS, PANEL, VARIABLES

GAP_LENGTH = """lengths AS MATERIALIZED (SELECT station_id, variable, t, count(*) OVER (PARTITION BY station_id, variable, is_synthetic, island) AS gap_length
  FROM (SELECT *, t - row_number() OVER (PARTITION BY station_id, variable, is_synthetic ORDER BY t) AS island FROM hidden) WHERE is_synthetic)"""


def cells_sql(masked: str = MASKED, inner: str = LINE, around: str = AROUND.format(src="hidden"), src: str = "around") -> str:
    """Hidden cells with estimate and gap length."""
    return f"""{masked}, {around}, {GAP_LENGTH},
hidden_cells AS (SELECT a.station_id, a.variable, a.t, a.ts, a.truth, {with_ends(inner)} AS estimate, l.gap_length
  FROM {src} a JOIN lengths l USING (station_id, variable, t) WHERE a.is_eval)"""


METRICS = """round(sqrt(avg((estimate - truth) ** 2)), 4) AS rmse, round(avg(abs(estimate - truth)), 4) AS mae, round(avg((estimate - truth) ** 2), 2) AS mse,
  round(avg(estimate - truth), 4) AS bias, round(1 - sum((estimate - truth) ** 2) / nullif(count(*) * var_pop(truth), 0), 6) AS r2, count(*) AS n"""
BINS = """CASE WHEN gap_length < 6 THEN '1-6h' WHEN gap_length < 24 THEN '6-24h' WHEN gap_length < 72 THEN '24-72h'
  WHEN gap_length < 168 THEN '72-168h' ELSE '>168h' END"""
SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END"
LIMITS = "limits AS (SELECT quantile_cont(truth, 0.05::DOUBLE) AS q0, quantile_cont(truth, 0.95::DOUBLE) AS q1 FROM hidden_cells)"
EXTREME = "CASE WHEN truth < q0 THEN 'extreme_low' WHEN truth > q1 THEN 'extreme_high' ELSE 'normal' END"
LINEAR = cells_sql()
REALISTIC = cells_sql(MASKED.replace(mask_sql(MCAR), mask_sql(EMPIRICAL)))
AKIMA = cells_sql(around=akima_sql("hidden"), inner=CURVE, src="joined")


def rounded(table):
    return table.withColumns({c: F.round(c, p) for c, p in (("rmse", 4), ("mae", 4), ("mse", 2), ("bias", 4), ("r2", 6))})


def scored(v, spec=MCAR, method="linear"):
    hidden = plan.hide(v.grid(), VARIABLES, spec, SEED, v.samples())
    return plan.estimate(hidden, {"estimate": method}, VARIABLES)


def _by(name, stratum, sql=LINEAR, extra="", source="hidden_cells"):
    return f"WITH {sql}{extra} SELECT '{name}' AS stratification, {stratum} AS stratum, {METRICS} FROM {source} GROUP BY 2"


@query(
    "hidden_cells",
    f"""WITH {MASKED}, {GAP_LENGTH} SELECT h.station_id, h.variable, h.t, h.truth, h.value, h.is_synthetic, h.is_eval, coalesce(l.gap_length, 0) AS gap_length
        FROM hidden h LEFT JOIN lengths l USING (station_id, variable, t)""",
)
def _(v):
    hidden = plan.hide(v.grid(), VARIABLES, MCAR, SEED, v.samples())
    return plan.estimate(hidden, {}, VARIABLES).drop("ts")


@query(
    "hidden_cells_per_station",
    f"""WITH {MASKED}, {GAP_LENGTH}, c AS (SELECT h.*, coalesce(l.gap_length, 0) AS gap_length FROM hidden h LEFT JOIN lengths l USING (station_id, variable, t))
        SELECT station_id, variable, count(*) AS n, count(*) FILTER (is_synthetic) AS n_hidden, count(*) FILTER (is_eval) AS n_eval, count(value) AS n_shown,
          sum(gap_length)::BIGINT AS gap_lengths, max(gap_length)::BIGINT AS longest, round(sum(truth) FILTER (is_eval), 2) AS hidden_truth FROM c GROUP BY 1, 2""",
)
def _(v):
    """What ``hidden_cells`` holds, counted up per series."""
    cells = plan.estimate(plan.hide(v.grid(), VARIABLES, MCAR, SEED, v.samples()), {}, VARIABLES)
    return cells.groupBy("station_id", "variable").agg(
        F.count("*").alias("n"),
        F.count_if("is_synthetic").alias("n_hidden"),
        F.count_if("is_eval").alias("n_eval"),
        F.count("value").alias("n_shown"),
        F.sum("gap_length").alias("gap_lengths"),
        F.max("gap_length").alias("longest"),
        F.round(F.sum(F.when(F.col("is_eval"), F.col("truth"))), 2).alias("hidden_truth"),
    )


@query("metrics_overall", f"WITH {LINEAR} SELECT {METRICS} FROM hidden_cells")
def _(v):
    return rounded(score.all_metrics(scored(v)))


@query("metrics_by_gap_length", _by("gap_length", BINS, REALISTIC))
def _(v):
    return rounded(score.by_gap_length(scored(v, EMPIRICAL)))


@query("metrics_by_variable", _by("variable", "variable"))
def _(v):
    return rounded(score.by_variable(scored(v)))


@query("metrics_by_season", _by("season", SEASON))
def _(v):
    return rounded(score.by_season(scored(v)))


@query("metrics_by_extremes", _by("extremes", EXTREME, extra=f", {LIMITS}", source="hidden_cells, limits"))
def _(v):
    return rounded(score.by_extremes(scored(v)))


@query(
    "metrics_by_extremes_per_variable",
    f"""WITH {LINEAR}, limits AS (SELECT variable, quantile_cont(truth, 0.05::DOUBLE) AS q0, quantile_cont(truth, 0.95::DOUBLE) AS q1 FROM hidden_cells GROUP BY 1)
        SELECT 'extremes' AS stratification, {EXTREME} AS stratum, {METRICS} FROM hidden_cells JOIN limits USING (variable) GROUP BY 2""",
)
def _(v):
    return rounded(score.by_extremes(scored(v), by="variable"))


_STRATA = {"gap_length": BINS, "variable": "variable", "extremes": EXTREME, "season": SEASON}


@query(
    "stratified_metrics",
    f"WITH {REALISTIC}, {LIMITS} "
    + " UNION ALL ".join(f"SELECT '{n}' AS stratification, {s} AS stratum, {METRICS} FROM hidden_cells, limits GROUP BY 2" for n, s in _STRATA.items()),
)
def _(v):
    return rounded(score.stratified_metrics(scored(v, EMPIRICAL)))


def _evaluation(sql):
    strata = {"overall": "'all'", "gap_length": BINS, "variable": "variable", "season": SEASON}
    return f"WITH {sql} " + " UNION ALL ".join(
        f"SELECT '{n}' AS stratification, {s} AS stratum, {METRICS} FROM hidden_cells GROUP BY 2" for n, s in strata.items()
    )


@query("evaluate_linear", _evaluation(LINEAR))
def _(v):
    return rounded(plan.evaluate(v.grid(), VARIABLES, MCAR, "linear", SEED, samples=v.samples()))


@query("evaluate_akima", _evaluation(AKIMA))
def _(v):
    return rounded(plan.evaluate(v.grid(), VARIABLES, MCAR, "akima", SEED, samples=v.samples()))


@query("evaluate_chained")
def _(v):
    return rounded(plan.evaluate(v.grid(), VARIABLES, MCAR, "chained", SEED, samples=v.samples()))


# --- paired tests -------------------------------------------------------------

ERRORS = f"""{MASKED}, {akima_sql('hidden')},
errors AS (SELECT station_id, t, variable, {with_ends(LINE)} - truth AS err_a, {with_ends('lv')} - truth AS err_b, {with_ends(CURVE)} - truth AS err_c FROM joined WHERE is_eval)"""


def errors(v, methods=("linear", "carry_forward")):
    return plan.method_errors(v.grid(), VARIABLES, MCAR, methods, SEED, v.samples())


@query(
    "method_errors",
    f"WITH {ERRORS} SELECT station_id, t, variable, round(err_a + 1e-9::DOUBLE, 5) AS err_a, round(err_b + 1e-9::DOUBLE, 5) AS err_b FROM errors",
)
def _(v):
    return errors(v).select("station_id", "t", "variable", F.round(F.col("err_a") + 1e-9, 5).alias("err_a"), F.round(F.col("err_b") + 1e-9, 5).alias("err_b"))


@query(
    "method_errors_per_station",
    f"""WITH {ERRORS} SELECT station_id, variable, count(*) AS n, round(sum(err_a) + 1e-6::DOUBLE, 3) AS sum_a, round(sum(err_b) + 1e-6::DOUBLE, 3) AS sum_b,
          round(max(abs(err_a)) + 1e-9::DOUBLE, 4) AS most_a, round(max(abs(err_b)) + 1e-9::DOUBLE, 4) AS most_b FROM errors GROUP BY 1, 2""",
)
def _(v):
    """What ``method_errors`` holds, summed up per series."""
    a, b = F.col("err_a"), F.col("err_b")
    return errors(v).groupBy("station_id", "variable").agg(
        F.count("*").alias("n"),
        F.round(F.sum(a) + 1e-6, 3).alias("sum_a"),
        F.round(F.sum(b) + 1e-6, 3).alias("sum_b"),
        F.round(F.max(F.abs(a)) + 1e-9, 4).alias("most_a"),
        F.round(F.max(F.abs(b)) + 1e-9, 4).alias("most_b"),
    )


@query(
    "paired_t_test",
    f"""WITH {ERRORS}, s AS (SELECT variable, count(*) AS n, avg(err_a - err_b) AS d, stddev_samp(err_a - err_b) AS sd FROM errors GROUP BY 1)
        SELECT variable, 'paired_t_test' AS test_name, n, round(d, 4) AS mean_diff, round(d / (sd / sqrt(n)), 4) AS statistic, round(d / sd, 6) AS effect_size FROM s""",
)
def _(v):
    tests = significance.paired_t_test(errors(v), ["variable"])
    return tests.select(
        "variable",
        "test_name",
        "n",
        F.round("mean_diff", 4).alias("mean_diff"),
        F.round("statistic", 4).alias("statistic"),
        F.round("effect_size", 6).alias("effect_size"),
    )


def _dm(loss):
    return f"""WITH {ERRORS}, s AS (SELECT variable, count(*) AS n, avg({loss}) AS d, var_samp({loss}) AS va FROM errors GROUP BY 1)
        SELECT variable, 'diebold_mariano' AS test_name, n, round(d / sqrt(va / n), 4) AS statistic FROM s"""


@query("diebold_mariano_squared", _dm("err_a * err_a - err_b * err_b"))
def _(v):
    tests = significance.diebold_mariano_test(errors(v), ["variable"])
    return tests.select("variable", "test_name", "n", F.round("statistic", 4).alias("statistic"))


@query("diebold_mariano_absolute", _dm("abs(err_a) - abs(err_b)"))
def _(v):
    tests = significance.diebold_mariano_test(errors(v), ["variable"], loss="absolute")
    return tests.select("variable", "test_name", "n", F.round("statistic", 4).alias("statistic"))


_SIGNED = """signed AS (SELECT variable, round(err_a - err_b + 1e-9::DOUBLE, 4) AS d FROM errors WHERE round(err_a - err_b + 1e-9::DOUBLE, 4) <> 0),
ranked AS (SELECT variable, d, rank() OVER (PARTITION BY variable ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variable, abs(d)) - 1) / 2.0::DOUBLE AS r FROM signed),
ties AS (SELECT variable, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT variable, count(*) AS c FROM signed GROUP BY variable, abs(d)) GROUP BY 1),
sums AS (SELECT variable, count(*) AS n, sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus FROM ranked GROUP BY 1)"""


@query(
    "wilcoxon_signed_rank",
    f"""WITH {ERRORS}, {_SIGNED} SELECT variable, 'wilcoxon_signed_rank' AS test_name, n, w_plus, w_minus, least(w_plus, w_minus) AS statistic,
          round((w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 6) AS z FROM sums JOIN ties USING (variable)""",
)
def _(v):
    """Differences are rounded so that equal ones tie on both engines."""
    pairs = errors(v).withColumn("err_a", F.round(F.col("err_a") - F.col("err_b") + 1e-9, 4)).withColumn("err_b", F.lit(0.0))
    tests = significance.wilcoxon_signed_rank_test(pairs, ["variable"])
    return tests.select("variable", "test_name", "n", "w_plus", "w_minus", "statistic", F.round("z", 6).alias("z"))


def _tail_sql(z: str) -> str:
    """Two-sided normal tail: the error function's series with odd double factorials, and far out the continued fraction."""
    inverse, terms = 1.0, []
    for n in range(81):
        inverse /= 2 * n + 1
        terms.append(f"{inverse!r}::DOUBLE")
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    fraction = "0.0::DOUBLE"
    for n in range(80, 0, -1):
        fraction = f"({n / 2.0}::DOUBLE / (x + {fraction}))"
    return f"""(SELECT CASE WHEN x IS NULL THEN NULL WHEN x < 2.5::DOUBLE
      THEN 1.0::DOUBLE - 2.0::DOUBLE / sqrt(pi()) * exp(-x * x) * x * list_sum(list_transform([{", ".join(terms)}], lambda c, i: c * pow(2.0::DOUBLE * x * x, i - 1)))
      ELSE exp(-x * x) / sqrt(pi()) / (x + {fraction}) END FROM (SELECT {x} AS x))"""


def _verdict_sql(difference: str) -> str:
    return f"""p_value < 0.05::DOUBLE AS significant, CASE WHEN statistic IS NULL THEN 'undecided: too few pairs, or all alike'
      WHEN p_value < 0.05::DOUBLE THEN CASE WHEN {difference} < 0 THEN 'A has the smaller errors' ELSE 'B has the smaller errors' END ELSE 'no difference shown' END AS interpretation"""


_PER_SERIES = ["station_id", "variable"]


def _tested(tests):
    return tests.select(*_PER_SERIES, "n", F.round("p_value", 8).alias("p_value"), "significant", "interpretation")


@query(
    "paired_t_test_p_values",
    f"""WITH {ERRORS}, s AS (SELECT station_id, variable, count(*) AS n, avg(err_a - err_c) AS d, stddev_samp(err_a - err_c) AS sd FROM errors GROUP BY 1, 2),
        z AS (SELECT *, CASE WHEN n >= 2 AND sd > 0 THEN d / (sd / sqrt(n)) END AS statistic FROM s),
        p AS (SELECT *, CASE WHEN statistic IS NULL THEN 1.0::DOUBLE WHEN n > 30 THEN {_tail_sql('z.statistic')} END AS p_value FROM z)
        SELECT station_id, variable, n, round(p_value, 8) AS p_value, coalesce(significant, false) AS significant, interpretation
        FROM (SELECT *, {_verdict_sql('d')} FROM p)""",
)
def _(v):
    """One test per series, so that p-values of all sizes occur."""
    return _tested(significance.paired_t_test(errors(v, ("linear", "akima")), _PER_SERIES))


def _dm_p_sql(loss):
    return f"""WITH {ERRORS}, s AS (SELECT station_id, variable, count(*) AS n, avg({loss}) AS d, var_samp({loss}) AS va FROM errors GROUP BY 1, 2),
        z AS (SELECT *, CASE WHEN n >= 2 AND va > 0 THEN d / sqrt(va / n) END AS statistic FROM s),
        p AS (SELECT *, coalesce({_tail_sql('z.statistic')}, 1.0::DOUBLE) AS p_value FROM z)
        SELECT station_id, variable, n, round(p_value, 8) AS p_value, significant, interpretation FROM (SELECT *, {_verdict_sql('d')} FROM p)"""


@query("diebold_mariano_p_values", _dm_p_sql("err_a * err_a - err_c * err_c"))
def _(v):
    return _tested(significance.diebold_mariano_test(errors(v, ("linear", "akima")), _PER_SERIES))


@query(
    "wilcoxon_p_values",
    f"""WITH {ERRORS}, signed AS (SELECT station_id, variable, round(err_a - err_c + 1e-9::DOUBLE, 4) AS d FROM errors WHERE round(err_a - err_c + 1e-9::DOUBLE, 4) <> 0),
        ranked AS (SELECT *, rank() OVER (PARTITION BY station_id, variable ORDER BY abs(d)) + (count(*) OVER (PARTITION BY station_id, variable, abs(d)) - 1) / 2.0::DOUBLE AS r FROM signed),
        ties AS (SELECT station_id, variable, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT station_id, variable, count(*) AS c FROM signed GROUP BY station_id, variable, abs(d)) GROUP BY 1, 2),
        s AS (SELECT station_id, variable, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM ranked GROUP BY 1, 2),
        z AS (SELECT s.*, least(w_plus, w_minus) AS statistic, (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(nullif(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE, 0)) AS zz
              FROM s JOIN ties USING (station_id, variable)),
        p AS (SELECT *, coalesce({_tail_sql('z.zz')}, 1.0::DOUBLE) AS p_value FROM z)
        SELECT station_id, variable, n, round(p_value, 8) AS p_value, significant, interpretation FROM (SELECT *, {_verdict_sql('zz')} FROM p)""",
)
def _(v):
    pairs = errors(v, ("linear", "akima")).withColumn("err_a", F.round(F.col("err_a") - F.col("err_b") + 1e-9, 4)).withColumn("err_b", F.lit(0.0))
    return _tested(significance.wilcoxon_signed_rank_test(pairs, _PER_SERIES))


@query("paired_tests_with_p_values")
def _(v):
    pairs = checkpointed(errors(v, ("linear", "akima")))
    common = ["variable", "test_name", "n", "statistic", "p_value", "interpretation"]
    tests = [
        significance.paired_t_test(pairs, ["variable"]).select(*common),
        significance.diebold_mariano_test(pairs, ["variable"]).select(*common),
        significance.wilcoxon_signed_rank_test(pairs, ["variable"]).select(*common),
    ]
    return significance.bonferroni(tests[0].unionByName(tests[1]).unionByName(tests[2]))


@query(
    "bonferroni_adjustment",
    f"""WITH {PANEL}, p AS (SELECT station_id, variable, round(avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) / 100.0::DOUBLE, 8) AS p_value FROM panel GROUP BY 1, 2)
        SELECT station_id, variable, p_value, round(least(p_value * (SELECT count(*) FROM p), 1.0::DOUBLE), 6) AS p_adjusted FROM p""",
)
def _(v):
    share = F.round(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)) / 100.0, 8)
    tests = v.panel().groupBy("station_id", "variable").agg(share.alias("p_value"))
    return significance.bonferroni(tests).select("station_id", "variable", "p_value", F.round("p_adjusted", 6).alias("p_adjusted"))


_WEIGHT = " + ".join(
    f"CASE WHEN u >= {step!r}::DOUBLE THEN 1 ELSE 0 END" for step in significance.POISSON_STEPS
)


@query(
    "bootstrap_intervals",
    f"""WITH {ERRORS}, s AS (SELECT variable, station_id, count(*) AS c, sum(err_a) AS s, sum(abs(err_a)) AS a, sum(err_a * err_a) AS q FROM errors GROUP BY 1, 2),
        d AS (SELECT s.*, r, ('0x' || substr(md5(concat_ws('|', '{SEED}', r, station_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM s, (SELECT unnest(generate_series(0, 999)) AS r)),
        w AS (SELECT *, {_WEIGHT} AS w FROM d),
        t AS (SELECT variable, r, sqrt(sum(w * q) / sum(w * c)) AS rmse, sum(w * a) / sum(w * c) AS mae, sum(w * s) / sum(w * c) AS bias FROM w WHERE w > 0 GROUP BY 1, 2)
        SELECT variable, count(*) AS replicas, """
    + ", ".join(
        f"round(quantile_cont({m}, {p}::DOUBLE), 4) AS {m}_{side}" for m in ("rmse", "mae", "bias") for side, p in (("low", 0.025), ("high", 0.975))
    )
    + " FROM t GROUP BY 1",
)
def _(v):
    limits = significance.bootstrap_intervals(errors(v), ["variable"], replicas=1000, seed=SEED)
    return limits.withColumns({c: F.round(c, 4) for c in limits.columns if c not in ("variable", "replicas")})


# --- ensembles ----------------------------------------------------------------

_SHIFTS = (-3.0, -1.0, 0.0, 0.5, 2.0, 4.0)


def ensemble(v):
    """Six shifted linear fills per hidden cell."""
    cells = scored(v).where("is_eval")
    shifted = F.inline(F.array(*[F.struct(F.lit(i).alias("imputation"), (F.col("estimate") + x).alias("value")) for i, x in enumerate(_SHIFTS)]))
    samples = ensembles.collect_samples(cells.select("station_id", "t", "variable", shifted))
    truth = cells.select("station_id", "t", "variable", "truth", "is_eval")
    return truth.join(samples, ["station_id", "t", "variable"])


_ENSEMBLE = f"""{LINEAR}, members AS (SELECT station_id, t, variable, truth, estimate + x AS value FROM hidden_cells, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _SHIFTS)}) s(x))"""


@query(
    "mean_crps",
    f"""WITH {_ENSEMBLE}, near AS (SELECT station_id, t, variable, avg(abs(value - truth)) AS d FROM members GROUP BY 1, 2, 3),
        spread AS (SELECT a.station_id, a.t, a.variable, avg(abs(a.value - b.value)) AS d FROM members a JOIN members b USING (station_id, t, variable) GROUP BY 1, 2, 3)
        SELECT variable, round(avg(n.d - 0.5::DOUBLE * s.d), 4) AS crps, count(*) AS n FROM near n JOIN spread s USING (station_id, t, variable) GROUP BY 1""",
)
def _(v):
    return ensembles.mean_crps(ensemble(v)).withColumn("crps", F.round("crps", 4))


@query(
    "interval_coverage",
    f"""WITH {_ENSEMBLE}, l AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS level),
        band AS (SELECT station_id, t, variable, level, any_value(truth) AS truth, quantile_cont(value, 0.25::DOUBLE) AS l50, quantile_cont(value, 0.75::DOUBLE) AS h50,
            quantile_cont(value, 0.05::DOUBLE) AS l90, quantile_cont(value, 0.95::DOUBLE) AS h90, quantile_cont(value, 0.025::DOUBLE) AS l95, quantile_cont(value, 0.975::DOUBLE) AS h95
          FROM members, l GROUP BY 1, 2, 3, 4),
        edge AS (SELECT variable, level, truth, CASE level WHEN 0.5 THEN l50 WHEN 0.9 THEN l90 ELSE l95 END AS lo, CASE level WHEN 0.5 THEN h50 WHEN 0.9 THEN h90 ELSE h95 END AS hi FROM band)
        SELECT variable, level, round(avg(CASE WHEN truth BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 4) AS mean_width, count(*) AS n FROM edge GROUP BY 1, 2""",
)
def _(v):
    table = ensembles.interval_coverage(ensemble(v))
    return table.withColumn("coverage", F.round("coverage", 6)).withColumn("mean_width", F.round("mean_width", 4))


@query("evaluate_posterior_imputations")
def _(v):
    """Metrics, CRPS and coverage of ten draws of the chain per hidden cell; tests compare them with numpy and SQL."""
    return plan.evaluate_imputations(v.grid(), VARIABLES, MCAR, 10, seed=SEED, samples=v.samples())


# --- climate indices ----------------------------------------------------------


def climate_cells(v):
    """Reports with a truth and an estimate that is off by a known rule."""
    return v.obs().select(
        F.col("source").alias("station_id"),
        "ts",
        F.col("temperature").alias("truth"),
        (F.col("temperature") * 0.9 + 1.0).alias("estimate"),
    )


_DAILY = f"""{OBS}, climate AS (SELECT source AS station_id, ts, temperature AS truth, temperature * 0.9::DOUBLE + 1.0::DOUBLE AS estimate FROM obs),
daily AS (SELECT station_id, CAST(ts AS DATE) AS day, 'truth' AS source, avg(truth) AS mean, min(truth) AS lo, max(truth) AS hi FROM climate GROUP BY 1, 2 HAVING avg(truth) IS NOT NULL
  UNION ALL SELECT station_id, CAST(ts AS DATE), 'estimate', avg(estimate), min(estimate), max(estimate) FROM climate GROUP BY 1, 2 HAVING avg(estimate) IS NOT NULL)"""


@query(
    "degree_days",
    f"""WITH {_DAILY} SELECT station_id, CAST(year(day) AS INTEGER) AS year, source, round(sum(greatest(18 - mean, 0)), 4) AS heating, round(sum(greatest(mean - 18, 0)), 4) AS cooling,
          round(sum(greatest(mean - 10, 0)), 4) AS growing, count(*) AS n_days FROM daily GROUP BY 1, 2, 3""",
)
def _(v):
    table = downstream.degree_days(climate_cells(v))
    return table.withColumns({c: F.round(c, 4) for c in ("heating", "cooling", "growing")})


@query(
    "degree_days_compared",
    f"""WITH {_DAILY}, d AS (SELECT station_id, CAST(year(day) AS INTEGER) AS year, source, sum(greatest(18 - mean, 0)) AS heating, sum(greatest(mean - 18, 0)) AS cooling FROM daily GROUP BY 1, 2, 3),
        w AS (SELECT station_id, year, max(heating) FILTER (source = 'truth') AS ht, max(heating) FILTER (source = 'estimate') AS he, max(cooling) FILTER (source = 'truth') AS ct, max(cooling) FILTER (source = 'estimate') AS ce FROM d GROUP BY 1, 2)
        SELECT station_id, year, round(ht, 4) AS heating_truth, round(he, 4) AS heating_estimate, round(ct, 4) AS cooling_truth, round(ce, 4) AS cooling_estimate,
          round(he - ht, 4) AS heating_diff, round(ce - ct, 4) AS cooling_diff FROM w""",
)
def _(v):
    table = downstream.compare_sources(downstream.degree_days(climate_cells(v)), ["station_id", "year"], ["heating", "cooling"])
    return table.withColumns({c: F.round(c, 4) for c in table.columns if c not in ("station_id", "year")})


_HOT, _COLD = 60.0, 0.5
_SPELLS = f"""{_DAILY}, flagged AS (SELECT station_id, source, 'heat' AS kind, day FROM daily WHERE hi > {_HOT}::DOUBLE UNION ALL SELECT station_id, source, 'cold', day FROM daily WHERE lo < {_COLD}::DOUBLE),
isl AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY station_id, source, kind ORDER BY day) AS INTEGER) AS island FROM flagged),
spells AS (SELECT station_id, source, kind, min(day) AS start, count(*) AS n_days FROM isl GROUP BY station_id, source, kind, island HAVING count(*) >= 3)"""


@query("extreme_spells", f"WITH {_SPELLS} SELECT station_id, source, kind, CAST(start AS VARCHAR) AS start, n_days FROM spells")
def _(v):
    return downstream.extreme_spells(climate_cells(v), _HOT, _COLD).withColumn("start", F.col("start").cast("string"))


@query(
    "spell_totals",
    f"WITH {_SPELLS} SELECT station_id, kind, source, count(*) AS n_spells, sum(n_days)::BIGINT AS spell_days FROM spells GROUP BY 1, 2, 3",
)
def _(v):
    return downstream.spell_totals(downstream.extreme_spells(climate_cells(v), _HOT, _COLD))
