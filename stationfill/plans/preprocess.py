"""Selected stations to train, validation and test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import masks, reports, splits, stations


EVERY = "all"


def split_masks(samples: DataFrame, variables, spec: masks.MaskSpec, seed: int = 42, panel: DataFrame | None = None) -> DataFrame:
    """The simulated strategy: cells hidden in each split (split, station_id, t, variable, k), drawn apart."""
    drawn = [
        masks.synthetic_mask(samples, variables, spec, splits.split_seed(seed, name), panel).withColumn("split", F.lit(name))
        for name in splits.SPLITS
    ]
    return reduce(DataFrame.unionByName, drawn)


def prepare(
    observations: DataFrame,
    station_table: DataFrame,
    selected: DataFrame,
    strategy: str = "spatial",
    variables=C.TIER1_VARIABLES,
    hourly_only: bool = True,
    suspect: bool = False,
    normalization: str = "none",
    seed: int = 42,
    **ratios,
) -> DataFrame:
    """Reports of the selected stations, flagged values blanked, with station constants and ``split``.

    Every report is in the result once. Spatial and hybrid strategies give all reports of a station
    its split; the temporal one cuts each station's reports by their place in its range; under the
    simulated one, splits are masks over the same reports (``split_masks``) and ``split`` is "all".
    Values stay in their own units; the label says which normalisation is meant.
    """
    chosen = stations.restrict_to(station_table, selected)
    # Checks names and ratios for every strategy.
    assignment = splits.create_split(strategy, chosen, seed=seed, **ratios)
    rows = reports.keep_hourly(observations) if hourly_only else observations
    rows = reports.blank_flagged_values(rows, variables, suspect=suspect)
    keep = [c for c in ("station_id", "ts", "report_type") if c in rows.columns]
    present = [v for v in variables if v in rows.columns]
    rows = rows.select(*keep, *present)
    if strategy == "temporal":
        ends = chosen.select("station_id", F.col("first_observation").alias("__first"), F.col("last_observation").alias("__last"))
        label = splits.temporal_label("ts", "__first", "__last", **{k: v for k, v in ratios.items() if k in splits.SPLITS})
        rows = rows.join(ends, "station_id").withColumn("split", label).drop("__first", "__last")
    elif strategy == "simulated":
        rows = stations.restrict_to(rows, chosen).withColumn("split", F.lit(EVERY))
    else:
        rows = rows.join(assignment, "station_id")
    return stations.attach_constants(rows, chosen, normalization)


def write_splits(prepared: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One write, one folder per split."""
    prepared.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark, path: str, split: str) -> DataFrame:
    """Only the folder of the wanted split is listed and read, or the one that all splits share."""
    return spark.read.parquet(path).where(F.col("split").isin(split, EVERY))
