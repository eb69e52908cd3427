"""Hide cells, fill them, score the result. Only methods that are fitted run jobs while the plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chained, ensembles, fill, masks, score, series
from ..operators.blocks import nearest_points
from ..operators.imputers import CELL, IMPUTERS, Imputer
from ..session import checkpointed


def hide(panel: DataFrame, variables, spec: masks.MaskSpec, seed, samples: DataFrame | None = None) -> DataFrame:
    """Long panel with ``truth``, ``value`` (NULL where hidden), ``is_synthetic`` and ``is_eval``.

    ``panel`` is long, or a grid with a column per variable: that is joined with the mask
    before it is unfolded, which moves as many times fewer rows.
    """
    samples = masks.sample_sizes(panel) if samples is None else samples
    runs = masks.synthetic_runs(samples, variables, spec, seed, panel)
    if "variable" not in panel.columns:
        return masks.hidden_panel(panel, variables, runs)
    return masks.apply_mask(panel, masks.run_cells(runs, variables))


def estimate(hidden: DataFrame, methods: dict[str, str | Imputer], variables, max_gap: int | None = None, **options) -> DataFrame:
    """Add the run length of every hidden cell and one estimate column per entry of ``methods``.

    ``methods`` maps column names to names in ``IMPUTERS`` or to imputers. Everything that looks along a
    series (gap lengths and all methods along time) shares one shuffle. Only cells
    that are not hidden are seen by the methods.
    """
    unknown = {m for m in methods.values() if isinstance(m, str)} - set(IMPUTERS)
    if unknown:
        raise ValueError(f"methods must be among {sorted(IMPUTERS)}, got {sorted(unknown)}")
    along = {column: fill.ALONG_TIME[m] for column, m in methods.items() if isinstance(m, str) and m in fill.ALONG_TIME}
    shown = F.when(~F.col("is_synthetic"), F.lit(True))
    points = {"shown": (shown, 1)}
    if along:
        points[fill.POINTS] = (F.col("value"), max(depth for depth, _ in along.values()))
    around = series.gap_columns(nearest_points(hidden, series.SERIES, points, bounds=True), "shown")
    for column, (_, add) in along.items():
        around = add(around, column, max_gap)
    length = F.when(F.col("is_synthetic"), F.col("gap_length")).otherwise(F.lit(0)).cast("bigint")
    out = around.select(*hidden.columns, length.alias("gap_length"), *along)
    for column, method in methods.items():
        if column not in along:
            imputer = IMPUTERS[method](**options) if isinstance(method, str) else method
            seen = hidden.select(*CELL, "value")
            done = imputer.fit(seen, variables).impute(seen)
            out = out.join(done.select(*CELL, F.col("filled").alias(column)), CELL)
    return out


def evaluate(
    panel: DataFrame,
    variables,
    spec: masks.MaskSpec = masks.MaskSpec(),
    method: str | Imputer = "linear",
    seed=42,
    strata=("gap_length", "variable", "season"),
    max_gap: int | None = None,
    samples: DataFrame | None = None,
) -> DataFrame:
    """Long table of metrics: one row overall and one per stratum."""
    hidden = hide(panel, variables, spec, seed, samples)
    cells = estimate(hidden, {"estimate": method}, variables, max_gap)
    return score.stratified_metrics(cells, ("overall", *strata))


def hidden_samples(
    grid: DataFrame,
    variables,
    spec: masks.MaskSpec,
    n_imputations: int,
    posterior: bool = True,
    seed=42,
    samples: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Hidden observed cells with ``truth``, ``samples`` (an imputation each) and their mean as ``estimate``.

    ``grid`` has a row per station and step and a column per variable. Chained equations are
    fitted on what the mask leaves; all imputations of a cell are one array, so there is one row per cell.
    ``options`` go to ``chained.fit_chained``.
    """
    samples = masks.sample_sizes(grid) if samples is None else samples
    runs = masks.synthetic_runs(samples, variables, spec, seed, grid)
    keys = [c for c in grid.columns if c not in variables]
    # Read by the fit and by the imputation.
    hidden = checkpointed(masks.hide_in_grid(grid, variables, runs))
    seen = hidden.select(
        *keys, *[F.when(~masks.is_hidden(v), F.col(name)).alias(name) for v, name in enumerate(variables)],
        F.struct(*[F.when(masks.is_hidden(v), F.col(name)).cast("double").alias(name) for v, name in enumerate(variables)]).alias("__truth"),
    )
    model = chained.fit_chained(seen, variables, **options)
    # Rows are completed one by one, so those without a cell to score need no draws.
    scored = seen.where(F.coalesce(*[F.col("__truth")[name] for name in variables]).isNotNull())
    drawn = chained.impute_samples(scored, model, n_imputations, posterior, seed)
    cells = [
        F.struct(F.lit(name).alias("variable"), F.col("__truth")[name].alias("truth"), F.col(name).alias("samples")) for name in variables
    ]
    long = drawn.select(*keys, F.inline(F.array(*cells))).where(F.col("truth").isNotNull())
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    return long.withColumns({"estimate": mean, "is_eval": F.lit(True)})


def evaluate_imputations(
    grid: DataFrame,
    variables,
    spec: masks.MaskSpec = masks.MaskSpec(),
    n_imputations: int = 10,
    posterior: bool = True,
    seed=42,
    levels=(0.5, 0.9, 0.95),
    samples: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Per variable, and over all (``variable`` "all"): metrics of the mean imputation, CRPS, and for
    every level the coverage and mean width of the central interval of the imputations."""
    cells = hidden_samples(grid, variables, spec, n_imputations, posterior, seed, samples, **options)
    ordered = cells.withColumn("__o", F.array_sort("samples"))
    truth, measures = F.col("truth"), [F.avg(ensembles.crps(F.col("samples"), F.col("truth"))).alias("crps")]
    for level in levels:
        low, high = (ensembles.sample_quantile(F.col("__o"), (1 + side * level) / 2) for side in (-1, 1))
        label = f"{round(level * 100, 6):g}".replace(".", "_")
        measures += [F.avg(truth.between(low, high).cast("double")).alias(f"coverage_{label}"), F.avg(high - low).alias(f"width_{label}")]
    each = ordered.withColumn("variable", F.explode(F.array(F.lit("all"), F.col("variable"))))
    return each.groupBy("variable").agg(*score.metric_columns(truth, F.col("estimate")), *measures)


def method_errors(
    panel: DataFrame, variables, spec: masks.MaskSpec, methods=("linear", "carry_forward"), seed=42, samples: DataFrame | None = None
) -> DataFrame:
    """Signed errors of two methods side by side on the hidden cells."""
    hidden = hide(panel, variables, spec, seed, samples)
    cells = estimate(hidden, {"a": methods[0], "b": methods[1]}, variables).where("is_eval")
    return cells.select(
        "station_id", "t", "variable", (F.col("a") - F.col("truth")).alias("err_a"), (F.col("b") - F.col("truth")).alias("err_b")
    )
