"""Grouping stations by k-means on standardised features."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stations in a task of a k-means step, if there are more than enough for all cores.
ROWS_PER_TASK = 1 << 18


def cluster_stations(stations: DataFrame, features, k: int = 5, seed: int = 42, starts: int = 10) -> DataFrame:
    """Add ``cluster``: best of ``starts`` runs; NULL where a feature is missing."""
    features = list(features)
    if len(features) < 2:
        raise ValueError("clustering needs at least two features")
    complete = stations.select("station_id", *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    assembler = VectorAssembler(inputCols=features, outputCol="raw")
    # The station table is read once per k-means step, so it is kept; lost parts are recomputed.
    complete.persist()
    scaled = None
    try:
        n = complete.count()
        if n < k:
            raise ValueError(f"fewer than {k} complete stations")
        # Hundreds of steps report a few KB a task to the driver each, so tasks go by stations, not by shuffle partitions.
        tasks = max(stations.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
        assembled = assembler.transform(complete.coalesce(tasks))
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(assembled)
        scaled = scaler.transform(assembled).select("station_id", "features").persist()
        models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(scaled) for i in range(starts)]
    finally:
        for kept in (scaled, complete):
            if kept is not None:
                kept.unpersist()
    best = min(models, key=lambda model: model.summary.trainingCost)
    labels = best.transform(scaler.transform(assembler.transform(complete))).select("station_id", "cluster")
    return stations.join(labels, "station_id", "left")
