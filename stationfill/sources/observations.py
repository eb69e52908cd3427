"""Observation files: one parquet per station and year, with drifting schemas.

Files lie at ``{root}/{year}/GHCNh_{station}_{year}.parquet``. All stations are
read at once. Columns get lower-case names and fixed types here, so nothing
downstream depends on the generation of a file.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import reports as R
from ..operators.reports import unify_timestamps
from ..session import fan_out, setting

# Fixed value: how a file name gives station and year.
FILE_PATTERN = r"GHCNh_([^/]+)_(\d{4})\.parquet$"


def parse_years(text: str | None) -> list[int] | None:
    """``"2010,2012:2015"`` to sorted distinct years; ranges include both ends, unreadable parts are skipped."""
    if text is None or not text.strip():
        return None
    years: set[int] = set()
    for part in text.split(","):
        ends = part.strip().split(":")
        try:
            numbers = [int(end) for end in ends]
        except ValueError:
            continue
        if len(numbers) <= 2:
            years.update(range(numbers[0], numbers[-1] + 1))
    return sorted(years)


def parse_stations(text: str | None) -> list[str] | None:
    """``"usw1, caX"`` to upper-case ids."""
    if text is None or not text.strip():
        return None
    return [part.strip().upper() for part in text.split(",") if part.strip()]


def in_years(years: list[int] | None, ts: str = "ts") -> Column:
    """Reports of these years, as ranges of instants, which file formats can skip by."""
    if years is None:
        return F.lit(True)
    runs: list[list[int]] = []
    for year in sorted(set(years)):
        if runs and runs[-1][1] == year:
            runs[-1][1] = year + 1
        else:
            runs.append([year, year + 1])
    day = lambda year: F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    chosen = F.lit(False)
    for first, end in runs:
        chosen = chosen | ((F.col(ts) >= day(first)) & (F.col(ts) < day(end)))
    return chosen


def of_stations(df: DataFrame, ids: list[str] | None, station: str = "station_id") -> Column:
    """Reports of these stations, compared in the column's own type; ids that do not fit the type name no station."""
    if ids is None:
        return F.lit(True)
    kind = dict(df.dtypes)[station]
    if kind == "string":
        return F.col(station).isin(ids)
    return F.col(station).isin([int(i) for i in ids if i.lstrip("-").isdigit()])


def list_files(spark: SparkSession, root: str, years: list[int] | None = None) -> DataFrame:
    """``file, station_id, year, size, modified_at``; contents are not read, and tasks list shares of a folder."""
    from .archive_source import listing

    found = listing(spark, root, years)
    modified = F.timestamp_millis("modified_ms").cast("timestamp_ntz").alias("modified_at")
    return found.select("file", "station_id", "year", "size", modified)


def in_folder(path: Column) -> Column:
    """Folder and name of a file, which are the same however its path is spelled."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1)


def list_stations(files: DataFrame) -> DataFrame:
    return files.select("station_id").distinct()


def list_years(files: DataFrame, station_id: str | None = None) -> DataFrame:
    rows = files if station_id is None else files.where(F.col("station_id") == station_id)
    return rows.select("year").distinct()


# How the Python side names what Spark's schemes name.
_SCHEMES = (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/"))


def _is_corrupt(error: Exception) -> bool:
    """A file that is no parquet file or has a broken footer, as opposed to one that could not be reached."""
    import pyarrow as pa

    return isinstance(error, pa.ArrowInvalid) or "thrift" in str(error).lower() or "magic bytes" in str(error).lower()


def _footers(files: DataFrame) -> DataFrame:
    """``(file, column, type, error)``: a row per column, or one with the error of a corrupt file."""

    def footers(batches):
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            found = []
            for file in batch["file"]:
                uri = file
                for ours, theirs in _SCHEMES:
                    if uri.startswith(ours):
                        uri = theirs + uri.removeprefix(ours).lstrip("/")
                try:
                    system, path = fs.FileSystem.from_uri(uri)
                    schema = pq.read_schema(path, filesystem=system)
                except Exception as error:
                    if not _is_corrupt(error):
                        raise
                    found.append((file, None, None, str(error)))
                    continue
                found += [(file, field.name, str(field.type), None) for field in schema]
            yield pd.DataFrame(found, columns=["file", "column", "type", "error"])

    spread = files.select("file").repartition(fan_out(files.sparkSession), "file")
    return spread.mapInPandas(footers, "file string, column string, type string, error string")


def schema_census(files: DataFrame) -> DataFrame:
    """Column names and types of every readable file, from the footers only: ``(file, column, type)``."""
    return _footers(files).where(F.col("error").isNull()).drop("error")


def unreadable_files(files: DataFrame) -> DataFrame:
    """``(file, error)`` of the files that reading leaves out: those with no usable footer."""
    return _footers(files).where(F.col("error").isNotNull()).select("file", "error")


def _generations(files: DataFrame, listed: DataFrame) -> list[list[str]]:
    """Paths to read together, one list per distinct schema.

    A folder with a single schema is named as a whole, if all of its files (``listed``) are
    wanted and readable; file names are needed only for the others. Hidden behind one hash per file, the census stays small.
    """
    census = schema_census(files)
    entry = F.concat_ws(" ", "column", "type")
    per_file = census.groupBy("file").agg(F.md5(F.array_join(F.sort_array(F.collect_list(entry)), ";")).alias("shape"))
    folder = F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    groups: dict[str, list[str]] = defaultdict(list)
    # Footers are read once, for folders and names.
    tagged = per_file.withColumn("folder", folder).persist()
    try:
        shapes = tagged.groupBy("folder").agg(F.min("shape").alias("one"), F.count_distinct("shape").alias("n_shapes"), F.count("*").alias("n_read"))
        in_folders = listed.withColumn("folder", folder).groupBy("folder").agg(F.count("*").alias("n_listed"))
        whole = (F.col("n_shapes") == 1) & (F.col("n_listed") == F.col("n_read"))
        status = shapes.join(in_folders, "folder").select("folder", "one", whole.alias("whole")).collect()
        for row in status:
            if row["whole"]:
                groups[row["one"]].append(row["folder"])
        mixed = [row["folder"] for row in status if not row["whole"]]
        if mixed:
            for row in tagged.where(F.col("folder").isin(mixed)).select("file", "shape").collect():
                groups[row["shape"]].append(row["file"])
    finally:
        tagged.unpersist()
    return list(groups.values())


def normalize(df: DataFrame) -> DataFrame:
    """Lower-case names; numbers as DOUBLE, codes as text; types are taken from the schema, not the data.

    Two columns that differ only by case are merged, the first non-NULL one winning.
    """
    numeric = {name.lower() for name in C.NUMERIC_COLUMNS}
    spellings: dict[str, list[str]] = defaultdict(list)
    for name in df.columns:
        lowered = name.lower()
        if lowered.endswith("_report_type_code"):
            lowered = lowered.removesuffix("_code")
        spellings[lowered].append(name)
    columns = []
    for lowered, names in spellings.items():
        variants: list[Column] = []
        for name in names:
            kind = df.schema[name].dataType
            column = F.col(f"`{name}`")
            if lowered in numeric:
                column = R.plain_number(column, kind)
            elif lowered.endswith("_quality_code"):
                column = R.plain_code(column, kind)
            variants.append(column)
        columns.append((variants[0] if len(variants) == 1 else F.coalesce(*variants)).alias(lowered))
    return df.select(*columns)


def read_observations(
    spark: SparkSession,
    root: str,
    years: list[int] | None = None,
    stations: list[str] | DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """Reports of all stations and years as one table with ``station_id, year, ts, report_type``.

    ``years`` selects folders, so other years are not even listed. A list of
    stations filters by file name; a long one is given as a DataFrame. Files without a
    usable footer are left out (``unreadable_files`` lists them); any other error is raised.
    With ``files`` (of ``list_files``) only these are read, and reports carry ``file``, its folder and name.
    """
    listed = list_files(spark, root, years)
    by_file, files = files is not None, listed if files is None else files
    if isinstance(stations, DataFrame):
        files = files.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    elif stations is not None:
        files = files.where(F.col("station_id").isin(stations))
    parts = []
    for paths in _generations(files, listed):
        # Spark lists many paths in a task each, unless told otherwise.
        with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", fan_out(spark)):
            raw = spark.read.option("pathGlobFilter", "GHCNh_*.parquet").parquet(*paths)
        path = F.col("_metadata.file_path")
        named = raw.withColumn("__station", F.regexp_extract(path, FILE_PATTERN, 1)).withColumn(
            "__year", F.regexp_extract(path, FILE_PATTERN, 2).cast("int")
        )
        if by_file:
            named = named.withColumn("__file", in_folder(path))
        tidy = unify_timestamps(normalize(named)).drop("date", "year", "month", "day", "hour", "minute")
        parts.append(tidy.withColumnsRenamed({"__station": "station_id", "__year": "year", "__file": "file"}))
    if not parts:
        raise FileNotFoundError(f"no readable observation file under {root}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "temperature_report_type" in rows.columns:
        rows = rows.withColumn("report_type", F.col("temperature_report_type"))
    else:
        rows = rows.withColumn("report_type", F.lit(None).cast("string"))
    if isinstance(stations, DataFrame):
        return rows.join(stations.select("station_id").distinct(), "station_id", "left_semi")
    return rows if stations is None else rows.where(F.col("station_id").isin(stations))


def available_columns(files: DataFrame, station_id: str, year: int) -> DataFrame:
    """Columns of one station's file, from its footer."""
    one = files.where((F.col("station_id") == station_id) & (F.col("year") == year))
    return schema_census(one).select("column", "type")
