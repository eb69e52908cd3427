"""Assigning stations to train, validation and test: one table ``(station_id, split)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import shuffled_rank

SPLITS = ("train", "val", "test")


def _check(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")


def spatial_split(stations: DataFrame, train=0.7, val=0.15, test=0.15, seed=42) -> DataFrame:
    """Shuffled ids: the first int(n·train) train, the next int(n·val) val, the rest test."""
    _check(train, val, test)
    n_train, n_val = F.floor(F.col("n_ids") * train), F.floor(F.col("n_ids") * val)
    split = F.when(F.col("position") <= n_train, "train").when(F.col("position") <= n_train + n_val, "val").otherwise("test")
    return shuffled_rank(stations, "station_id", seed).select("station_id", split.alias("split"))


def hybrid_split(stations: DataFrame, train=0.7, val=0.15, test=0.15, spatial_weight=0.5, seed=42) -> DataFrame:
    """Some stations are held out for test; the others are cut by ratios that share out the rest."""
    _check(train, val, test)
    if not 0.0 <= spatial_weight <= 1.0:
        raise ValueError("spatial_weight must be in [0, 1]")
    left = train + val + test * (1.0 - spatial_weight)
    held = F.floor(F.col("n_ids") * test * spatial_weight)
    place, rest = F.col("position") - held, F.col("n_ids") - held
    n_train, n_val = F.floor(rest * (train / left)), F.floor(rest * (val / left))
    split = (
        F.when(place <= 0, "test").when(place <= n_train, "train").when(place <= n_train + n_val, "val").otherwise("test")
    )
    return shuffled_rank(stations, "station_id", seed).select("station_id", split.alias("split"))


def every_split(stations: DataFrame) -> DataFrame:
    """All stations in all three splits (simulated and temporal strategies differ in cells, not stations)."""
    labels = F.explode(F.array(*[F.lit(s) for s in SPLITS]))
    return stations.select("station_id").distinct().select("station_id", labels.alias("split"))


def temporal_split(stations: DataFrame, train=0.7, val=0.15, test=0.15) -> DataFrame:
    """All stations in all splits; cut their rows with ``series.temporal_segments``."""
    _check(train, val, test)
    missing = {"first_observation", "last_observation"} - set(stations.columns)
    if missing:
        raise ValueError(f"temporal split needs {sorted(missing)}")
    return every_split(stations)


def temporal_label(ts: str, first: str, last: str, train=0.7, val=0.15, test=0.15) -> Column:
    """The split of a row by its place between its station's first and last report, in seconds.

    Rows outside of that range belong to the nearer end; rows without an instant are training rows.
    """
    _check(train, val, test)
    place = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col(first).cast("timestamp"))
    n = F.unix_seconds(F.col(last).cast("timestamp")) - F.unix_seconds(F.col(first).cast("timestamp")) + 1
    n_train, n_val = F.floor(n * train), F.floor(n * val)
    return F.when(place.isNull() | (place < n_train), "train").when(place < n_train + n_val, "val").otherwise("test")


def split_seed(seed: int, split: str) -> str:
    """Label of the mask draws of one split under the simulated strategy."""
    return f"{seed}-{split}"


def create_split(strategy: str, stations: DataFrame, train=0.7, val=0.15, test=0.15, seed=42, spatial_weight=0.5) -> DataFrame:
    if strategy == "spatial":
        return spatial_split(stations, train, val, test, seed)
    if strategy == "hybrid":
        return hybrid_split(stations, train, val, test, spatial_weight, seed)
    if strategy == "temporal":
        return temporal_split(stations, train, val, test)
    if strategy == "simulated":
        _check(train, val, test)
        return every_split(stations)
    raise ValueError(f"unknown split strategy {strategy!r}")
