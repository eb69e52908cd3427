"""Normalising values per variable, with statistics over all stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("zscore", "minmax", "none")


def fit_scale(panel: DataFrame, keys=("variable",)) -> DataFrame:
    """Observed mean, sample std, min, max and count; constants get a usable spread.

    Grouping has few keys and no distinct state, so each task sends one row per key.
    """
    stats = panel.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min_val"),
        F.max("value").alias("max_val"),
        F.count("value").alias("n_observed"),
    )
    none = F.raise_error(F.concat(F.lit("no observed value for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    return stats.select(
        *keys,
        "mean",
        F.when(F.coalesce("std", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("std")).alias("std"),
        "min_val",
        F.when(F.col("max_val") == F.col("min_val"), F.col("min_val") + 1.0).otherwise(F.col("max_val")).alias("max_val"),
        F.when(F.col("n_observed") > 0, F.col("n_observed")).otherwise(none.cast("bigint")).alias("n_observed"),
    )


def _joined(panel: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Attach the statistics, a row per key.

    A row per variable is a table of fixed size and sent to every task: without the hint the panel has been
    shuffled by variable, all of one into one task, before Spark knows how small the other side is.
    """
    wanted = stats.select(*keys, "mean", "std", "min_val", "max_val")
    return panel.join(F.broadcast(wanted) if tuple(keys) == ("variable",) else wanted, list(keys), "left")


def scale(panel: DataFrame, stats: DataFrame, method="zscore", clip: float | None = None, keys=("variable",)) -> DataFrame:
    """Replace ``value`` by its normalised form; missing cells stay missing."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "none":
        return panel
    value = F.col("value")
    if method == "zscore":
        scaled = (value - F.col("mean")) / F.col("std")
        if clip is not None:
            scaled = F.when(value.isNotNull(), F.greatest(F.least(scaled, F.lit(float(clip))), F.lit(-float(clip))))
    else:
        scaled = (value - F.col("min_val")) / (F.col("max_val") - F.col("min_val"))
    return _joined(panel, stats, keys).withColumn("value", scaled).select(*panel.columns)


def unscale(panel: DataFrame, stats: DataFrame, method="zscore", keys=("variable",)) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "none":
        return panel
    value = F.col("value")
    if method == "zscore":
        original = value * F.col("std") + F.col("mean")
    else:
        original = value * (F.col("max_val") - F.col("min_val")) + F.col("min_val")
    return _joined(panel, stats, keys).withColumn("value", original).select(*panel.columns)


def normalize_variables(panel: DataFrame, method="zscore", clip: float | None = None) -> tuple[DataFrame, DataFrame]:
    stats = fit_scale(panel)
    return scale(panel, stats, method, clip), stats
