"""Gap filling: lines, Akima curves, chained equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chained, fill, masks
from ..session import checkpointed
from .registry import query
from .series_queries import MCAR, SEED, mask_sql
from .views import PANEL, VARIABLES

# Added before rounding, on both engines: inputs with few decimals make exact ties, which then round by noise.
NUDGE = 1e-9


def _nudged(column, places=6):
    return F.round(F.col(column) + NUDGE, places).alias(column)


# Nearest observed cell on each side of a missing one, by window functions over the whole series.
AROUND = """around AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY station_id, variable ORDER BY t) AS lt,
  last_value(value IGNORE NULLS) OVER (PARTITION BY station_id, variable ORDER BY t) AS lv,
  last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY station_id, variable ORDER BY t DESC) AS rt,
  last_value(value IGNORE NULLS) OVER (PARTITION BY station_id, variable ORDER BY t DESC) AS rv FROM {src})"""


def with_ends(inner: str, max_gap: int | None = None) -> str:
    if max_gap is not None:
        inner = f"CASE WHEN rt - lt - 1 <= {max_gap} THEN {inner} END"
    return f"""CASE WHEN value IS NOT NULL THEN value WHEN lt IS NULL AND rt IS NULL THEN 0.0::DOUBLE
  WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN lv ELSE {inner} END"""


LINE = "lv + (rv - lv) * ((t - lt)::DOUBLE / (rt - lt))"


@query(
    "linear_fill",
    f"WITH {PANEL}, {AROUND.format(src='panel')} SELECT station_id, variable, t, round({with_ends(LINE)} + {NUDGE}::DOUBLE, 6) AS filled FROM around",
)
def _(v):
    return fill.linear_fill(v.panel()).select("station_id", "variable", "t", _nudged("filled"))


@query(
    "linear_fill_max_gap",
    f"WITH {PANEL}, {AROUND.format(src='panel')} SELECT station_id, variable, t, round({with_ends(LINE, 2)} + {NUDGE}::DOUBLE, 6) AS filled FROM around",
)
def _(v):
    return fill.linear_fill(v.panel(), max_gap=2).select("station_id", "variable", "t", _nudged("filled"))


@query(
    "carry_forward",
    f"WITH {PANEL}, {AROUND.format(src='panel')} SELECT station_id, variable, t, {with_ends('lv')} AS filled FROM around",
)
def _(v):
    return fill.carry_forward(v.panel()).select("station_id", "variable", "t", "filled")


def akima_sql(src: str) -> str:
    """Derivatives at the observed points, then a cubic between the two around each missing cell."""
    slope = lambda l2, l1, r1, r2: (
        f"CASE WHEN abs({r2} - {r1}) + abs({l1} - {l2}) > 1e-12::DOUBLE THEN (abs({r2} - {r1}) * {l1} + abs({l1} - {l2}) * {r1}) "
        f"/ (abs({r2} - {r1}) + abs({l1} - {l2})) ELSE ({l1} + {r1}) / 2.0::DOUBLE END"
    )
    w = "OVER (PARTITION BY station_id, variable ORDER BY t)"
    return f"""pts AS (SELECT station_id, variable, t, value, (lead(value) {w} - value) / (lead(t) {w} - t)::DOUBLE AS m FROM {src} WHERE value IS NOT NULL),
nb AS (SELECT *, lag(m) {w} AS m1, lag(m, 2) {w} AS m2, lead(m) {w} AS p1 FROM pts),
ext1 AS (SELECT *, coalesce(m, 2 * m1 - m2, m1) AS r1, coalesce(m1, 2 * m - p1, m) AS l1 FROM nb),
ext AS (SELECT *, coalesce(p1, 2 * r1 - l1) AS r2, coalesce(m2, 2 * l1 - r1) AS l2 FROM ext1),
node AS (SELECT station_id, variable, t, {slope('l2', 'l1', 'r1', 'r2')} AS d FROM ext),
{AROUND.format(src=src)},
joined AS (SELECT a.*, n.d AS ld, m.d AS rd, (a.t - a.lt)::DOUBLE / (a.rt - a.lt) AS s, (a.rt - a.lt)::DOUBLE AS h FROM around a
  LEFT JOIN node n ON n.station_id = a.station_id AND n.variable = a.variable AND n.t = a.lt
  LEFT JOIN node m ON m.station_id = a.station_id AND m.variable = a.variable AND m.t = a.rt)"""


CURVE = "(2*s*s*s - 3*s*s + 1) * lv + (s*s*s - 2*s*s + s) * h * ld + (-2*s*s*s + 3*s*s) * rv + (s*s*s - s*s) * h * rd"


@query(
    "akima_fill",
    f"WITH {PANEL}, {akima_sql('panel')} SELECT station_id, variable, t, round({with_ends(CURVE)} + {NUDGE}::DOUBLE, 5) AS filled FROM joined",
)
def _(v):
    return fill.akima_fill(v.panel()).select("station_id", "variable", "t", _nudged("filled", 5))


@query(
    "akima_fill_max_gap",
    f"WITH {PANEL}, {akima_sql('panel')} SELECT station_id, variable, t, round({with_ends(CURVE, 3)} + {NUDGE}::DOUBLE, 5) AS filled FROM joined",
)
def _(v):
    return fill.akima_fill(v.panel(), max_gap=3).select("station_id", "variable", "t", _nudged("filled", 5))


# --- chained equations --------------------------------------------------------


def masked_wide(v, variables=VARIABLES, seed=SEED):
    """The grid with hidden cells NULL; stored, since fits read it several times."""
    grid = masks.masked_grid(v.grid(), VARIABLES, masks.synthetic_runs(v.samples(), VARIABLES, MCAR, seed))
    return checkpointed(grid.select("station_id", "t", *variables))


MASKED = f"""{PANEL}, {mask_sql(MCAR)}, hidden AS MATERIALIZED (SELECT p.station_id, p.t, p.ts, p.variable, p.value AS truth, CASE WHEN m.k IS NULL THEN p.value END AS value,
  m.k IS NOT NULL AS is_synthetic, m.k IS NOT NULL AND p.value IS NOT NULL AS is_eval
  FROM panel p LEFT JOIN mask m ON m.station_id = p.station_id AND m.t = p.t AND m.variable = p.variable)"""


def _chain(a: str, b: str, rounds: int) -> str:
    """Two-variable least-squares chain, written out round by round."""
    ctes = f"""c0 AS (SELECT station_id, t, {a} AS ao, {b} AS bo, coalesce({a}, avg({a}) OVER ()) AS a, coalesce({b}, avg({b}) OVER ()) AS b FROM wide)"""
    previous = "c0"
    for r in range(1, rounds + 1):
        for step, (y, x) in (("a", ("a", "b")), ("b", ("b", "a"))):
            name = f"c{r}{step}"
            keep = "b" if y == "a" else "a"
            ctes += f""",
{name} AS (SELECT station_id, t, ao, bo, {keep}, coalesce({y}o, f.i + f.s * {x}) AS {y} FROM {previous},
  (SELECT regr_slope({y}o, {x}) AS s, regr_intercept({y}o, {x}) AS i FROM {previous}) f)"""
            previous = name
    return f"{ctes}\nSELECT station_id, t, a AS {a}, b AS {b} FROM {previous}"


_ROUNDS = 10


@query(
    "chained_least_squares",
    f"""WITH {MASKED}, wide AS (SELECT station_id, t, max(value) FILTER (variable = 'quantity') AS quantity, max(value) FILTER (variable = 'tax') AS tax FROM hidden GROUP BY 1, 2),
        qfirst AS (SELECT count(quantity) >= count(tax) AS yes FROM wide),
        one AS (WITH {_chain('quantity', 'tax', _ROUNDS)}), two AS (WITH {_chain('tax', 'quantity', _ROUNDS)})
        SELECT station_id, t, round(quantity, 4) AS quantity, round(tax, 6) AS tax FROM one WHERE (SELECT yes FROM qfirst)
        UNION ALL SELECT station_id, t, round(quantity, 4), round(tax, 6) FROM two WHERE NOT (SELECT yes FROM qfirst)""",
)
def _(v):
    """Two variables, ten rounds; those with fewer missing cells go first."""
    pair = ("quantity", "tax")
    wide = masked_wide(v, pair)
    model = chained.fit_chained(wide, pair, rounds=_ROUNDS, predictor="linear", tolerance=0)
    done = chained.impute_chained(wide, model)
    return done.select("station_id", "t", F.round("quantity", 4).alias("quantity"), F.round("tax", 6).alias("tax"))


@query(
    "missing_set_moments",
    f"""WITH {MASKED}, wide AS (SELECT station_id, t, max(value) FILTER (variable = 'quantity') AS quantity, max(value) FILTER (variable = 'tax') AS tax FROM hidden GROUP BY 1, 2)
        SELECT CAST((quantity IS NULL)::INTEGER + 2 * (tax IS NULL)::INTEGER AS INTEGER) AS missing_set, count(*) AS n,
          round(sum(coalesce((quantity - 25.0::DOUBLE) / 10.0::DOUBLE, 0)), 4) AS s_0, round(sum(coalesce((quantity - 25.0::DOUBLE) / 10.0::DOUBLE, 0) ** 2), 4) AS p_0_0,
          round(sum(coalesce((quantity - 25.0::DOUBLE) / 10.0::DOUBLE, 0) * coalesce(tax, 0)), 4) AS p_0_1,
          round(sum(coalesce(tax, 0)), 4) AS s_1, round(sum(coalesce(tax, 0) ** 2), 4) AS p_1_1 FROM wide GROUP BY 1""",
)
def _(v):
    pair = ("quantity", "tax")
    moments = chained.moments_by_missing_set(masked_wide(v, pair), pair, {"quantity": 25.0, "tax": 0.0}, {"quantity": 10.0, "tax": 1.0})
    number = (F.substring("missing_set", 1, 1) == "1").cast("int") + 2 * (F.substring("missing_set", 2, 1) == "1").cast("int")
    rounded = {c: F.round(c, 4) for c in moments.columns if c not in ("missing_set", "n")}
    return moments.withColumns({**rounded, "missing_set": number})


_CENTERS = dict(zip(VARIABLES, (25.0, 35000.0, 0.05, 0.04)))
_SPREADS = dict(zip(VARIABLES, (10.0, 20000.0, 0.03, 0.02)))


def _moments_sql() -> str:
    wide = ", ".join(f"max(value) FILTER (variable = '{x}') AS {x}" for x in VARIABLES)
    z = [f"coalesce(({x} - {_CENTERS[x]}::DOUBLE) / {_SPREADS[x]}::DOUBLE, 0)" for x in VARIABLES]
    number = " + ".join(f"{1 << i} * ({x} IS NULL)::INTEGER" for i, x in enumerate(VARIABLES))
    sums = [f"round(sum({a}), 4) AS s_{i}" for i, a in enumerate(z)]
    sums += [f"round(sum({z[i]} * {z[j]}), 4) AS p_{i}_{j}" for i in range(len(z)) for j in range(i, len(z))]
    return f"""WITH {MASKED}, wide AS (SELECT station_id, t, {wide} FROM hidden GROUP BY 1, 2)
        SELECT CAST({number} AS INTEGER) AS missing_set, count(*) AS n, {", ".join(sums)} FROM wide GROUP BY 1"""


@query("missing_set_moments_all_variables", _moments_sql())
def _(v):
    moments = chained.moments_by_missing_set(masked_wide(v), VARIABLES, _CENTERS, _SPREADS)
    bits = [(F.substring("missing_set", i + 1, 1) == "1").cast("int") * (1 << i) for i in range(len(VARIABLES))]
    rounded = {c: F.round(c, 4) for c in moments.columns if c not in ("missing_set", "n")}
    return moments.withColumns({**rounded, "missing_set": sum(bits[1:], bits[0])})


@query("chained_bayesian_ridge")
def _(v):
    wide = masked_wide(v)
    model = chained.fit_chained(wide, VARIABLES)
    return chained.impute_chained(wide, model).drop("imputation")


@query("chained_posterior_imputations")
def _(v):
    wide = masked_wide(v)
    model = chained.fit_chained(wide, VARIABLES)
    return chained.impute_chained(wide, model, n_imputations=5, posterior=True, seed=SEED)


@query("chained_mean_of_imputations")
def _(v):
    wide = masked_wide(v)
    model = chained.fit_chained(wide, VARIABLES)
    return chained.mean_imputation(chained.impute_chained(wide, model, n_imputations=5, posterior=True, seed=SEED), VARIABLES)


@query("chained_coefficients")
def _(v):
    wide = masked_wide(v)
    return chained.fit_chained(wide, VARIABLES).to_frame(v.spark)


@query("chained_random_forest")
def _(v):
    return chained.forest_chained(masked_wide(v), VARIABLES)
