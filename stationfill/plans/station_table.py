"""From observation files to a cleaned station table, whole or only what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata, stations
from ..sources import inventory as lists
from ..sources import observations, tables


def build(
    reports: DataFrame,
    inventory: DataFrame | None = None,
    hourly_only: bool = True,
    clean: bool = True,
    threshold: float = 0.01,
    strategy: str = "prefer_longer",
    computed_at: Column | None = None,
) -> DataFrame:
    """Station table of reports; gaps filled from the official list, and cleaned, if wanted.

    Cleaning drops stations with impossible coordinates and duplicates, and tidies names.
    """
    table = metadata.station_metadata(reports, hourly_only, computed_at)
    if inventory is not None:
        table = stations.enrich_from_inventory(table, inventory)
    return stations.clean_stations(table, threshold, strategy) if clean else table


def compute(
    spark: SparkSession,
    root: str,
    path: str,
    csv_path: str | None = None,
    years: str | None = None,
    only: str | None = None,
    inventory_path: str | None = None,
    incremental: bool = False,
    mode: str = "errorifexists",
    **options,
) -> DataFrame:
    """Read, build and write; returns the table as written.

    ``years`` and ``only`` are texts such as "2010,2012:2015" and "usw1,caX". With ``incremental``
    the table at ``path`` is read, stations with new or changed files are computed again, the others
    stay, and the result is written to ``path`` with ``-updated`` added: Spark cannot overwrite what it reads.
    """
    wanted_years, wanted = observations.parse_years(years), observations.parse_stations(only)
    inventory = lists.read_inventory(spark, inventory_path) if inventory_path else None
    if not incremental:
        table = build(observations.read_observations(spark, root, wanted_years, wanted), inventory, **options)
    else:
        existing, _ = tables.load_stations(spark, path)
        files = observations.list_files(spark, root, wanted_years)
        files = files if wanted is None else files.where(F.col("station_id").isin(wanted))
        stale = metadata.update_status(files, files, existing).where("status <> 'unchanged'")
        # Other stations' files are not opened, not even their footers.
        chosen = files.join(stale.select("station_id"), "station_id", "left_semi")
        if chosen.isEmpty():
            table = existing
        else:
            reports = observations.read_observations(spark, root, wanted_years, files=chosen).drop("file")
            table = metadata.merge_metadata(existing, build(reports, inventory, **options | {"clean": False}))
        path = f"{path}-updated"
    tables.save_stations(table, path, csv_path, mode)
    return spark.read.parquet(path)
