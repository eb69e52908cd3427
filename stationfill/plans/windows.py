"""Written preprocessing output to normalised training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale, series


def windows_from_reports(
    prepared: DataFrame,
    variables,
    window: int = 168,
    stride: int = 24,
    method: str = "zscore",
    stats: DataFrame | None = None,
) -> DataFrame:
    """Hourly grid, normalised with ``stats`` (fitted on the input when not given), cut into windows."""
    hourly = prepared.withColumn("t", series.hour_index(F.col("ts")).cast("int"))
    panel = series.regular_grid(series.first_per_step(hourly, variables), variables)
    fitted = scale.fit_scale(panel) if stats is None else stats
    return series.sliding_windows(scale.scale(panel, fitted, method), window, stride)
