"""Grids, gaps, windows, segments, normalisation and synthetic masks on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, metadata, ranks, scale, series, splits
from ..plans import windows as window_plan
from .registry import query
from .views import OBS, PANEL, VARIABLES

SEED = 42
RUNS = """marked AS (SELECT {k}, t, value, t - row_number() OVER (PARTITION BY {k}, value IS NULL ORDER BY t) AS island FROM {src}),
runs AS (SELECT {k}, min(t) AS start_t, count(*) AS length FROM marked WHERE value IS NULL GROUP BY {k}, island)"""


@query("weekly_grid", f"WITH {PANEL} SELECT * FROM panel")
def _(v):
    return v.panel()


@query(
    "hourly_grid",
    f"""WITH {OBS}, cells AS (SELECT source AS station_id, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS INTEGER) AS t,
            arg_min(temperature, ts) FILTER (temperature IS NOT NULL) AS value FROM obs GROUP BY 1, 2),
          ends AS (SELECT station_id, min(t) AS lo, max(t) AS hi FROM cells GROUP BY 1)
        SELECT e.station_id, CAST(g.t AS INTEGER) AS t, 'temperature' AS variable, c.value
        FROM (SELECT station_id, unnest(generate_series(lo, hi)) AS t FROM ends) g JOIN ends e USING (station_id) LEFT JOIN cells c ON c.station_id = e.station_id AND c.t = g.t""",
)
def _(v):
    """Irregular reports of one event type on an hourly grid."""
    obs = v.obs().withColumn("station_id", F.col("source")).withColumn("t", series.hour_index(F.col("ts")).cast("int"))
    return series.regular_grid(series.first_per_step(obs, ["temperature"]), ["temperature"])


@query("gap_runs", f"WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')} SELECT * FROM runs")
def _(v):
    return series.gap_runs(v.panel())


@query(
    "gap_lengths",
    f"""WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')}
        SELECT station_id, variable, t, CASE WHEN value IS NULL THEN count(*) OVER (PARTITION BY station_id, variable, value IS NULL, island) ELSE 0 END AS gap_length FROM marked""",
)
def _(v):
    return series.gap_lengths(v.panel()).select("station_id", "variable", "t", "gap_length")


_GAP_STATS = """cells_by AS (SELECT {k}, count(*) AS n_cells, count(*) FILTER (value IS NULL) AS n_missing FROM {src} GROUP BY {k}),
runs_by AS (SELECT {k}, count(*) AS n_gaps, avg(length) AS mean_length, quantile_cont(length::DOUBLE, 0.5::DOUBLE) AS median_length, max(length)::DOUBLE AS max_length FROM runs GROUP BY {k})
SELECT c.*, round(100.0::DOUBLE * n_missing / n_cells, 6) AS missing_pct, coalesce(n_gaps, 0) AS n_gaps, round(mean_length, 6) AS mean_length, median_length, max_length
FROM cells_by c LEFT JOIN runs_by r USING ({k})"""


def _rounded_gaps(stats):
    return stats.withColumns(
        {"missing_pct": F.round("missing_pct", 6), "mean_length": F.round("mean_length", 6), "max_length": F.col("max_length").cast("double")}
    )


@query(
    "gap_statistics",
    f"WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')}, {_GAP_STATS.format(k='station_id, variable', src='panel')}",
)
def _(v):
    return _rounded_gaps(series.gap_statistics(v.panel()))


@query(
    "gap_categories",
    f"""WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')}
        SELECT CASE WHEN length <= 6 THEN 'short' WHEN length <= 72 THEN 'medium' ELSE 'long' END AS category, count(*) AS n_gaps, sum(length)::BIGINT AS total_hours
        FROM runs GROUP BY 1""",
)
def _(v):
    return series.gap_categories(series.gap_runs(v.panel()))


@query(
    "gap_length_histogram",
    f"""WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')}, l AS (SELECT min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi FROM runs)
        SELECT coalesce(least(floor((length - lo) / nullif((hi - lo) / 50, 0)), 49), 0)::BIGINT AS bin, count(*) AS n FROM runs, l GROUP BY 1""",
)
def _(v):
    return metadata.histogram(series.gap_runs(v.panel()), "length", 50).select("bin", "n")


_EDGES = [2**i for i in range(10)]


@query(
    "gap_length_log_histogram",
    f"""WITH {PANEL}, {RUNS.format(k='station_id, variable', src='panel')}
        SELECT CAST(CASE WHEN length = 512 THEN 8 ELSE floor(log2(length::DOUBLE)) END AS INTEGER) AS bin, count(*) AS n FROM runs WHERE length <= 512 GROUP BY 1""",
)
def _(v):
    return metadata.edge_histogram(series.gap_runs(v.panel()), "length", _EDGES)


@query(
    "sliding_windows",
    f"""WITH {PANEL} SELECT p.station_id, p.variable, p.t, p.value, CAST(s.w AS INTEGER) AS window_start, CAST(p.t - s.w AS INTEGER) AS pos
        FROM panel p JOIN (SELECT unnest(generate_series(lo, hi + 1 - 104, 52)) AS w FROM span) s ON p.t >= s.w AND p.t < s.w + 104""",
)
def _(v):
    return series.sliding_windows(v.panel(), 104, 52).select("station_id", "variable", "t", "value", "window_start", "pos")


@query(
    "packed_windows",
    f"""WITH {PANEL} SELECT p.station_id, p.variable, CAST(s.w AS INTEGER) AS window_start, count(*) AS n_cells,
          count(p.value) AS n_observed, round(sum(coalesce(p.value, 0.0::DOUBLE) * (p.t - s.w)), 2) AS weighted
        FROM panel p JOIN (SELECT unnest(generate_series(lo, hi + 1 - 168, 24)) AS w FROM span) s ON p.t >= s.w AND p.t < s.w + 168 GROUP BY 1, 2, 3""",
)
def _(v):
    packed = series.window_arrays(v.panel())
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda a, c: a + f(c))
    return packed.select(
        "station_id",
        "variable",
        "window_start",
        F.size("cells").cast("bigint").alias("n_cells"),
        total(lambda c: c["mask"].cast("double")).cast("bigint").alias("n_observed"),
        F.round(total(lambda c: c["value"] * c["pos"]), 2).alias("weighted"),
    )


_SEGMENT = "CASE WHEN t - lo < floor(n * 0.7::DOUBLE) THEN 'train' WHEN t - lo < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END"


@query("temporal_segments", f"WITH {PANEL} SELECT station_id, variable, t, value, {_SEGMENT} AS segment FROM panel, span")
def _(v):
    return series.temporal_segments(v.panel()).drop("ts")


@query("take_segment", f"WITH {PANEL} SELECT station_id, variable, t, value FROM panel, span WHERE {_SEGMENT} = 'val'")
def _(v):
    return series.take_segment(series.temporal_segments(v.panel()), "val").drop("ts", "segment")


@query(
    "year_blocks",
    f"""WITH {PANEL} SELECT station_id, variable, t, CASE WHEN year(ts) <= 1998 THEN 'train' WHEN year(ts) = 1999 THEN 'val' ELSE 'test' END AS segment
        FROM panel WHERE year(ts) BETWEEN 1995 AND 2000""",
)
def _(v):
    blocks = (("train", 1995, 1998), ("val", 1999, 1999), ("test", 2000, 2000))
    return series.year_blocks(v.panel(), blocks).select("station_id", "variable", "t", "segment")


@query(
    "held_out_years",
    f"""WITH {PANEL} SELECT station_id, variable, t, CASE WHEN ('0x' || substr(md5('7|' || year(ts)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3::DOUBLE
          THEN 'test' ELSE 'train' END AS segment FROM panel""",
)
def _(v):
    return series.held_out_years(v.panel(), 0.3, 7).select("station_id", "variable", "t", "segment")


@query(
    "quantile_thresholds",
    f"""WITH {PANEL} SELECT round(quantile_cont(value, 0.15::DOUBLE), 6) AS q0, round(quantile_cont(value, 0.85::DOUBLE), 6) AS q1
        FROM panel WHERE variable = 'quantity' AND value IS NOT NULL""",
)
def _(v):
    one = v.panel().where("variable = 'quantity'")
    return ranks.exact_quantiles(one, "value", [0.15, 0.85]).select(F.round("q0", 6).alias("q0"), F.round("q1", 6).alias("q1"))


# --- normalisation ------------------------------------------------------------

_STATS = """stats AS (SELECT variable, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, count(value) AS n FROM panel GROUP BY 1)"""


@query(
    "fit_scale",
    f"WITH {PANEL}, {_STATS} SELECT variable, round(mean, 5) AS mean, round(std, 5) AS std, lo AS min_val, hi AS max_val, n AS n_observed FROM stats",
)
def _(v):
    return scale.fit_scale(v.panel()).withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(
    "fit_scale_per_station",
    f"""WITH {PANEL} SELECT station_id, variable, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min_val,
          max(value) AS max_val, count(value) AS n_observed FROM panel GROUP BY 1, 2""",
)
def _(v):
    stats = scale.fit_scale(v.panel(), ("station_id", "variable"))
    return stats.withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query(
    "scale_zscore_clipped",
    f"WITH {PANEL}, {_STATS} SELECT station_id, t, variable, round(greatest(least((value - mean) / std, 1.5::DOUBLE), -1.5::DOUBLE), 6) AS value FROM panel JOIN stats USING (variable) WHERE value IS NOT NULL",
)
def _(v):
    panel = v.panel()
    scaled = scale.scale(panel, scale.fit_scale(panel), "zscore", clip=1.5)
    return scaled.where(F.col("value").isNotNull()).select("station_id", "t", "variable", F.round("value", 6).alias("value"))


@query("scale_minmax", f"WITH {PANEL}, {_STATS} SELECT station_id, t, variable, round((value - lo) / (hi - lo), 6) AS value FROM panel JOIN stats USING (variable)")
def _(v):
    panel = v.panel()
    scaled = scale.scale(panel, scale.fit_scale(panel), "minmax")
    return scaled.select("station_id", "t", "variable", F.round("value", 6).alias("value"))


@query("unscale_round_trip", f"WITH {PANEL} SELECT station_id, t, variable, round(value, 4) AS value FROM panel")
def _(v):
    scaled, stats = scale.normalize_variables(v.panel(), "zscore")
    return scale.unscale(scaled, stats, "zscore").select("station_id", "t", "variable", F.round("value", 4).alias("value"))


# --- synthetic masks ----------------------------------------------------------


def draw(tag: str, seed=SEED) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', station_id, k, '{tag}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def draw_int(low, high, tag, seed=SEED) -> str:
    return f"CAST({low} + floor({draw(tag, seed)} * ({high} - ({low}) + 1)) AS BIGINT)"


def mask_sql(spec: masks.MaskSpec, seed=SEED, name: str = "mask", src: str = "panel") -> str:
    """The same draws, and one ordered count per sample in place of a sweep."""
    n_var = len(VARIABLES)
    steps = "(SELECT n FROM span)"
    target = f"CAST(floor({steps} * {n_var} * {spec.missing_ratio}::DOUBLE) AS BIGINT)"
    n_candidates = f"CAST(ceil({target} / {spec.mean_gap}::DOUBLE) * {spec.oversampling} AS BIGINT)"
    if spec.kind != "realistic":
        length = draw_int(spec.min_gap, spec.max_gap, "length", seed)
    elif spec.gap_distribution == "empirical":
        u, pick = draw("category", seed), lambda a, b: draw_int(a, b, "length", seed)
        length = f"CASE WHEN {u} < 0.5::DOUBLE THEN {pick(1, 6)} WHEN {u} < 0.9::DOUBLE THEN {pick(6, 72)} ELSE {pick(72, 336)} END"
    else:
        label = "concat_ws('|', '{0}', station_id, k, 'length', '{1}')"
        bits = lambda part: f"('0x' || substr(md5({label.format(seed, part)}), 1, 8))::BIGINT"
        z = f"sqrt(-2.0::DOUBLE * ln(({bits('radius')} + 1) / 4294967296.0::DOUBLE)) * cos({bits('angle')} / 4294967296.0::DOUBLE * 6.283185307179586::DOUBLE)"
        length = f"CAST(least(greatest(floor(exp(1.0::DOUBLE + 1.5::DOUBLE * {z})), 1), 336) AS BIGINT)"
    ctes = f"""{name}_cand AS (SELECT s.station_id, k, {draw_int(0, n_var - 1, 'variable', seed)} AS v, {length} AS len
  FROM (SELECT DISTINCT station_id FROM {src}) s, (SELECT unnest(generate_series(0, {n_candidates} - 1)) AS k))"""
    if spec.kind in ("mar", "mnar"):
        q = spec.extreme_percentile
        p = "0.75::DOUBLE"
        if spec.kind == "mnar":
            f, m = f"(n_extreme::DOUBLE / {steps})", f"{spec.extreme_multiplier}::DOUBLE"
            p = f"least(0.95::DOUBLE, greatest(0.05::DOUBLE, {m} * {f} / ({m} * {f} + 1.0::DOUBLE - {f})))"
        ctes += f""",
{name}_lim AS (SELECT quantile_cont(value, {q}::DOUBLE) AS lo, quantile_cont(value, {1.0 - q}::DOUBLE) AS hi FROM {src} WHERE variable = '{spec.condition_variable}' AND value IS NOT NULL),
{name}_steps AS (SELECT *, row_number() OVER (PARTITION BY station_id, ext ORDER BY t) AS place
  FROM (SELECT station_id, t, coalesce(value < lo OR value > hi, false) AS ext FROM {src}, {name}_lim WHERE variable = '{spec.condition_variable}')),
{name}_share AS (SELECT station_id, count(*) FILTER (ext) AS n_extreme, count(*) FILTER (NOT ext) AS n_normal FROM {name}_steps GROUP BY 1),
{name}_want AS (SELECT c.*, n_extreme, n_normal, n_extreme > 0 AND ({draw('class', seed).replace('station_id', 'c.station_id')} < {p} OR n_normal = 0) AS ext FROM {name}_cand c JOIN {name}_share s ON s.station_id = c.station_id),
{name}_pick AS (SELECT *, {draw_int(1, '(CASE WHEN ext THEN n_extreme ELSE n_normal END)', 'start', seed)} AS place FROM {name}_want),
{name}_start AS (SELECT p.station_id, p.k, p.v, p.len, CAST(s.t - (SELECT lo FROM span) AS BIGINT) AS start FROM {name}_pick p JOIN {name}_steps s ON s.station_id = p.station_id AND s.ext = p.ext AND s.place = p.place)"""
    else:
        ctes += f""",
{name}_start AS (SELECT *, {draw_int(0, f"({steps} - 1)", 'start', seed)} AS start FROM {name}_cand)"""
    names = ", ".join(f"'{v}'" for v in VARIABLES)
    return ctes + f""",
{name}_cells AS MATERIALIZED (SELECT station_id, v, p, min(k) AS k FROM (SELECT station_id, v, k, unnest(generate_series(start, least(start + len, {steps}) - 1)) AS p FROM {name}_start) GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT station_id, CAST((SELECT lo FROM span) + p AS INTEGER) AS t, [{names}][v + 1] AS variable, k
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY k, p) AS r FROM {name}_cells) WHERE r <= {target})"""


MCAR = masks.MaskSpec("mcar", 0.2, 1, 12)
MAR = masks.MaskSpec("mar", 0.2, 1, 12, condition_variable="quantity")
MNAR = masks.MaskSpec("mnar", 0.2, 1, 12, condition_variable="extendedprice")
EMPIRICAL = masks.MaskSpec("realistic", 0.2)
LOGNORMAL = masks.MaskSpec("realistic", 0.2, gap_distribution="lognormal")


def _register_mask(name, spec):
    @query(name, f"WITH {PANEL}, {mask_sql(spec)} SELECT station_id, t, variable, k FROM mask")
    def _(v):
        return masks.synthetic_mask(v.samples(), VARIABLES, spec, SEED, v.grid())


for _name, _spec in {
    "mask_mcar": MCAR,
    "mask_mar": MAR,
    "mask_mnar": MNAR,
    "mask_realistic_empirical": EMPIRICAL,
    "mask_realistic_lognormal": LOGNORMAL,
}.items():
    _register_mask(_name, _spec)


@query(
    "mask_totals",
    f"""WITH {PANEL}, {mask_sql(MCAR)} SELECT p.station_id, CAST(floor((SELECT n FROM span) * 4 * 0.2::DOUBLE) AS BIGINT) AS target, coalesce(m.n, 0) AS masked
        FROM (SELECT DISTINCT station_id FROM panel) p LEFT JOIN (SELECT station_id, count(*) AS n FROM mask GROUP BY 1) m USING (station_id)""",
)
def _(v):
    samples = v.samples()
    return masks.mask_totals(samples, masks.synthetic_mask(samples, VARIABLES, MCAR, SEED), len(VARIABLES), MCAR.missing_ratio)


@query(
    "apply_mask",
    f"""WITH {PANEL}, {mask_sql(MCAR)} SELECT p.station_id, p.t, p.variable, p.value AS truth, CASE WHEN m.k IS NULL THEN p.value END AS value,
          m.k IS NOT NULL AS is_synthetic, m.k IS NOT NULL AND p.value IS NOT NULL AS is_eval
        FROM panel p LEFT JOIN mask m ON m.station_id = p.station_id AND m.t = p.t AND m.variable = p.variable""",
)
def _(v):
    return masks.hidden_panel(v.grid(), VARIABLES, masks.synthetic_runs(v.samples(), VARIABLES, MCAR, SEED)).drop("ts")


@query(
    "holdout_masks",
    f"WITH {PANEL}, {mask_sql(MCAR)} SELECT station_id, t, variable, CASE WHEN k % 2 = 0 THEN 'val' ELSE 'test' END AS holdout FROM mask",
)
def _(v):
    mask = masks.synthetic_mask(v.samples(), VARIABLES, MCAR, SEED)
    return masks.holdout_masks(mask).select("station_id", "t", "variable", "holdout")


_SIMULATED = ", ".join(mask_sql(MCAR, splits.split_seed(SEED, s), f"mask_{s}") for s in splits.SPLITS)


@query(
    "simulated_split_masks",
    f"WITH {PANEL}, {_SIMULATED} " + " UNION ALL ".join(f"SELECT '{s}' AS split, station_id, t, variable FROM mask_{s}" for s in splits.SPLITS),
)
def _(v):
    """One mask per split over the same stations."""
    samples = v.samples()
    drawn = [
        masks.synthetic_mask(samples, VARIABLES, MCAR, splits.split_seed(SEED, s)).select(F.lit(s).alias("split"), "station_id", "t", "variable")
        for s in splits.SPLITS
    ]
    return drawn[0].unionByName(drawn[1]).unionByName(drawn[2])


_STRATEGIES = {"mcar": MCAR, "mar": MAR, "mnar": MNAR, "realistic": EMPIRICAL}
_STRATEGY_SQL = ", ".join(mask_sql(spec, SEED, f"m_{name}") for name, spec in _STRATEGIES.items())
_STRATEGY_CELLS = " UNION ALL ".join(
    f"SELECT '{n}' AS strategy, p.station_id, p.variable, p.t, CASE WHEN m.k IS NULL THEN 1 END AS value FROM panel p "
    f"LEFT JOIN m_{n} m ON m.station_id = p.station_id AND m.t = p.t AND m.variable = p.variable"
    for n in _STRATEGIES
)


@query(
    "gap_statistics_by_strategy",
    f"""WITH {PANEL}, {_STRATEGY_SQL}, masked AS ({_STRATEGY_CELLS}),
        {RUNS.format(k='strategy, station_id, variable', src='masked')}, {_GAP_STATS.format(k='strategy', src='masked')}""",
)
def _(v):
    drawn = {name: masks.synthetic_mask(v.samples(), VARIABLES, spec, SEED, v.grid()) for name, spec in _STRATEGIES.items()}
    cells = masks.cells_under_masks(v.panel_cells(), drawn, "strategy")
    masked = cells.withColumn("value", F.when(~F.col("hidden"), 1)).drop("hidden")
    return _rounded_gaps(series.gap_statistics(masked, ["strategy", "station_id", "variable"], ["strategy"]))


@query(
    "windows_from_reports",
    f"""WITH {OBS}, r AS (SELECT source AS station_id, CAST(floor(epoch_us(ts) / 3600000000.0::DOUBLE) AS INTEGER) AS t, ts, temperature, wind_direction FROM obs),
          cells AS (SELECT station_id, t, arg_min(temperature, ts) FILTER (temperature IS NOT NULL) AS temperature, arg_min(wind_direction, ts) AS wind_direction FROM r GROUP BY 1, 2),
          ends AS (SELECT station_id, min(t) AS lo, max(t) AS hi FROM cells GROUP BY 1),
          grid AS (SELECT station_id, unnest(generate_series(lo, hi)) AS t FROM ends),
          panel AS (SELECT g.station_id, g.t, v.variable, CASE v.variable WHEN 'temperature' THEN c.temperature ELSE c.wind_direction END AS value
            FROM grid g CROSS JOIN (VALUES ('temperature'), ('wind_direction')) v(variable) LEFT JOIN cells c ON c.station_id = g.station_id AND c.t = g.t),
          {_STATS},
          starts AS (SELECT station_id, lo, unnest(generate_series(0, hi - lo + 1 - 168, 24)) AS w FROM ends)
        SELECT p.station_id, p.variable, CAST(s.lo + s.w AS INTEGER) AS window_start, count(*) AS n_cells, count(p.value) AS n_observed, round(sum((p.value - x.mean) / x.std), 4) AS total
        FROM panel p JOIN starts s ON s.station_id = p.station_id AND p.t >= s.lo + s.w AND p.t < s.lo + s.w + 168 JOIN stats x ON x.variable = p.variable GROUP BY 1, 2, 3""",
)
def _(v):
    """Raw reports to normalised one-week windows, summed per window."""
    obs = v.obs().withColumn("station_id", F.col("source"))
    cut = window_plan.windows_from_reports(obs, ["temperature", "wind_direction"])
    return cut.groupBy("station_id", "variable", "window_start").agg(
        F.count("*").alias("n_cells"), F.count("value").alias("n_observed"), F.round(F.sum("value"), 4).alias("total")
    )
