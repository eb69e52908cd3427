"""Scoring several imputations of one cell: CRPS and interval coverage.

``samples`` is an array per cell, as long as the number of imputations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collect_samples(completed_long: DataFrame, keys=("station_id", "t", "variable")) -> DataFrame:
    """One row per cell; the array holds one value per imputation, so it stays short."""
    pairs = F.sort_array(F.collect_list(F.struct("imputation", "value")))
    return completed_long.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("samples"))


def crps(samples: Column, truth: Column) -> Column:
    """Mean distance to the truth minus half the mean distance between samples, from the sorted array."""
    s = F.size(samples)
    ordered = F.array_sort(samples)
    to_truth = F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x - truth)) / s
    spread = F.aggregate(
        F.transform(ordered, lambda x, i: x * (2 * i - s + 1)), F.lit(0.0), lambda a, x: a + x
    ) / (s * s)
    return to_truth - spread


def sample_quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation in a sorted array."""
    spot = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(spot).cast("int")
    high = F.ceil(spot).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return a + (b - a) * (spot - low)


def mean_crps(cells: DataFrame, by=("variable",)) -> DataFrame:
    scored = cells.where(F.col("is_eval") & F.col("truth").isNotNull())
    return scored.groupBy(*by).agg(F.avg(crps(F.col("samples"), F.col("truth"))).alias("crps"), F.count("*").alias("n"))


def interval_coverage(cells: DataFrame, levels=(0.5, 0.9, 0.95), by=("variable",)) -> DataFrame:
    """Share of truths inside the central interval of each level, and the interval's mean width."""
    scored = cells.where(F.col("is_eval") & F.col("truth").isNotNull()).withColumn("__o", F.array_sort("samples"))
    bands = [
        F.struct(
            F.lit(float(level)).alias("level"),
            sample_quantile(F.col("__o"), (1 - level) / 2).alias("low"),
            sample_quantile(F.col("__o"), (1 + level) / 2).alias("high"),
        )
        for level in levels
    ]
    return (
        scored.select(*by, "truth", F.inline(F.array(*bands)))
        .groupBy(*by, "level")
        .agg(
            F.avg(F.col("truth").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"),
            F.avg(F.col("high") - F.col("low")).alias("mean_width"),
            F.count("*").alias("n"),
        )
    )
