"""The station table kept up to date from one state per file.

States of files are appended to a table, never rewritten: a file that is new, or whose size or
time has changed, is read and adds its states; what the table has of earlier versions, or of
files that are gone, is passed over when states are read, by a join with the listing. So a run
reads the changed files and the states, and a run that is repeated changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..operators import day_states, metadata
from ..sources import observations

_VERSION = ("file", "size", "modified_at")


def _versions(files: DataFrame) -> DataFrame:
    return files.withColumn("file", observations.in_folder(F.col("file"))).select(*_VERSION)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def changed_files(spark: SparkSession, root: str, states: str, years: list[int] | None = None) -> DataFrame:
    """Files of the archive that have no state, or the state of another version."""
    files = observations.list_files(spark, root, years)
    known = _stored(spark, states)
    if known is None:
        return files
    named = files.withColumnRenamed("file", "path").withColumn("file", observations.in_folder(F.col("path")))
    new = named.join(known.select(*_VERSION).distinct(), list(_VERSION), "left_anti")
    return new.withColumn("file", F.col("path")).select(*files.columns)


def add_states(spark: SparkSession, root: str, states: str, years: list[int] | None = None, hourly_only: bool = True) -> DataFrame:
    """Append the states of new and changed files to the table at ``states``; gives these files."""
    run = uuid.uuid4().hex
    changed = changed_files(spark, root, states, years)
    chosen = f"{states.rstrip('/')}-runs/{run}"
    # Written down first: the listing of this run, whatever happens to the archive meanwhile.
    changed.write.parquet(chosen)
    changed = spark.read.parquet(chosen)
    if not changed.isEmpty():
        rows = observations.read_observations(spark, root, years, files=changed)
        fresh = day_states.day_states(rows, hourly_only, part="file").withColumnRenamed("part", "file")
        # A file without reports has a state too, so that it is not read again.
        fresh.join(_versions(changed), "file", "right").withColumn("run", F.lit(run)).write.mode("append").parquet(states)
    return changed


def valid_states(spark: SparkSession, root: str, states: str, years: list[int] | None = None) -> DataFrame:
    """The states of the archive's files as they are now; of a file that two runs have read, one run's."""
    stored = _stored(spark, states)
    if stored is None:
        raise FileNotFoundError(f"no states under {states}")
    listed = _versions(observations.list_files(spark, root, years))
    runs = stored.join(listed, list(_VERSION), "left_semi").groupBy(*_VERSION).agg(F.max("run").alias("run"))
    kept = stored.join(runs, [*_VERSION, "run"], "left_semi")
    return kept.where(F.col("station_id").isNotNull()).drop(*_VERSION, "run")


def station_table(
    spark: SparkSession,
    root: str,
    states: str,
    years: list[int] | None = None,
    hourly_only: bool = True,
    computed_at: Column | None = None,
) -> DataFrame:
    """Bring the states up to date and derive the station table of the whole archive from them.

    Equal to the table computed from all reports; only new and changed files are read.
    """
    add_states(spark, root, states, years, hourly_only)
    return metadata.metadata_of_states(day_states.merge_parts(valid_states(spark, root, states, years)), computed_at)


def compact(spark: SparkSession, root: str, states: str, target: str, years: list[int] | None = None) -> None:
    """Write only what is valid to a new table, with the versions and under one run."""
    stored = _stored(spark, states)
    if stored is None:
        raise FileNotFoundError(f"no states under {states}")
    listed = _versions(observations.list_files(spark, root, years))
    runs = stored.join(listed, list(_VERSION), "left_semi").groupBy(*_VERSION).agg(F.max("run").alias("run"))
    stored.join(runs, [*_VERSION, "run"], "left_semi").write.parquet(target)
