"""Scoring estimates on the cells that were hidden.

Input: ``truth``, ``estimate`` and ``is_eval`` per cell. Metrics are NULL where
they are undefined. Every table here comes from one grouped pass with few groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .ranks import exact_quantiles


def metric_columns(truth: Column, estimate: Column) -> list[Column]:
    e = estimate - truth
    both = e.isNotNull()
    y = F.when(both, truth)
    spread = F.count(y) * F.var_pop(y)
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.avg(e).alias("bias"),
        (1.0 - F.try_divide(F.sum(e * e), F.nullif(spread, F.lit(0.0)))).alias("r2"),
        F.count(e).alias("n"),
    ]


def _scored(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("is_eval"))


def all_metrics(cells: DataFrame) -> DataFrame:
    return _scored(cells).agg(*metric_columns(F.col("truth"), F.col("estimate")))


def gap_length_label(length: Column, bins=C.GAP_LENGTH_BINS) -> Column:
    """``1-6h``, ``6-24h``, …, ``>168h``; lower edges belong to their bin."""
    edges = [1, *bins]
    label = None
    for low, high in zip(edges, edges[1:]):
        test = (length >= low) & (length < high)
        label = F.when(test, f"{low}-{high}h") if label is None else label.when(test, f"{low}-{high}h")
    return label.when(length >= edges[-1], f">{edges[-1]}h")


def season_label(ts: Column) -> Column:
    """Meteorological season by UTC month."""
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "fall")
    )


def _grouped(labelled: DataFrame, stratification: str) -> DataFrame:
    return (
        labelled.where(F.col("stratum").isNotNull())
        .groupBy("stratum")
        .agg(*metric_columns(F.col("truth"), F.col("estimate")))
        .select(F.lit(stratification).alias("stratification"), "*")
    )


def by_gap_length(cells: DataFrame, bins=C.GAP_LENGTH_BINS) -> DataFrame:
    return _grouped(_scored(cells).withColumn("stratum", gap_length_label(F.col("gap_length"), bins)), "gap_length")


def by_variable(cells: DataFrame) -> DataFrame:
    return _grouped(_scored(cells).withColumn("stratum", F.col("variable")), "variable")


def by_season(cells: DataFrame) -> DataFrame:
    return _grouped(_scored(cells).withColumn("stratum", season_label(F.col("ts"))), "season")


def _with_extremes(cells: DataFrame, percentiles, by: str | None) -> DataFrame:
    """Add ``extreme_label`` to scored cells; thresholds come from the truth of all of them (per ``by``)."""
    low, high = percentiles
    if not 0 <= low < high <= 100:
        raise ValueError("percentiles must be ordered and within 0..100")
    cuts = exact_quantiles(cells, "truth", [low / 100.0, high / 100.0], by=by)
    if by is None:
        cuts = cuts.select(F.struct("q0", "q1")).scalar()
        joined, first, second = cells, cuts["q0"], cuts["q1"]
    else:
        # One row per group; Spark broadcasts it where its size allows.
        cuts = cuts.withColumnRenamed(by, "__by")
        joined = cells.join(cuts, F.col(by).eqNullSafe(F.col("__by")), "left")
        first, second = F.col("q0"), F.col("q1")
    label = F.when(F.col("truth") < first, "extreme_low").when(F.col("truth") > second, "extreme_high").otherwise("normal")
    return joined.withColumn("extreme_label", label).select(*cells.columns, "extreme_label")


def by_extremes(cells: DataFrame, percentiles=C.EXTREME_PERCENTILES, by: str | None = None) -> DataFrame:
    labelled = _with_extremes(_scored(cells), percentiles, by).withColumnRenamed("extreme_label", "stratum")
    return _grouped(labelled, "extremes")


def stratified_metrics(
    cells: DataFrame, strata=("gap_length", "variable", "extremes", "season"), bins=C.GAP_LENGTH_BINS, percentiles=C.EXTREME_PERCENTILES
) -> DataFrame:
    """Any of the four stratifications, and ``overall``, from one pass: a cell counts once in each."""
    unknown = set(strata) - {"gap_length", "variable", "extremes", "season", "overall"}
    if unknown:
        raise ValueError(f"unknown strata {sorted(unknown)}")
    scored = _scored(cells)
    if "extremes" in strata:
        scored = _with_extremes(scored, percentiles, None)
    rules = {
        "overall": lambda: F.lit("all"),
        "gap_length": lambda: gap_length_label(F.col("gap_length"), bins),
        "variable": lambda: F.col("variable"),
        "extremes": lambda: F.col("extreme_label"),
        "season": lambda: season_label(F.col("ts")),
    }
    pairs = F.array(*[F.struct(F.lit(s).alias("stratification"), rules[s]().alias("stratum")) for s in strata])
    return (
        scored.select("truth", "estimate", F.inline(pairs))
        .where(F.col("stratum").isNotNull())
        .groupBy("stratification", "stratum")
        .agg(*metric_columns(F.col("truth"), F.col("estimate")))
    )
