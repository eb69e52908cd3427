"""Reading and writing the tables this package produces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..operators.metadata import STATION_COLUMNS

# Quotes inside a field are doubled, as other CSV readers expect.
CSV_QUOTE = '"'


def ordered_station_columns(stations: DataFrame) -> DataFrame:
    """The fixed layout: completeness of any variable together and by name, validity last, further columns by name after it."""
    share = "_completeness_pct"
    front = STATION_COLUMNS[: next(i for i, c in enumerate(STATION_COLUMNS) if c.endswith(share))]
    back = [c for c in STATION_COLUMNS if c not in front and not c.endswith(share)]
    wanted = [*front, *sorted(c for c in stations.columns if c.endswith(share)), *back, "coord_valid"]
    known = [c for c in wanted if c in stations.columns]
    return stations.select(*known, *sorted(c for c in stations.columns if c not in known))


def as_flat(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats without them; missing fields are kept as null."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema
    ]
    return df.select(*columns)


def save_stations(stations: DataFrame, path: str, csv_path: str | None = None, mode: str = "errorifexists") -> None:
    ordered = ordered_station_columns(stations)
    ordered.write.mode(mode).parquet(path)
    if csv_path is not None:
        as_flat(ordered.sparkSession.read.parquet(path)).write.mode(mode).csv(csv_path, header=True, escape=CSV_QUOTE)


def load_stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The station table, and the schema versions in it other than the current one (normally none)."""
    stations = spark.read.parquet(path)
    if "metadata_schema_version" not in stations.columns:
        other = stations.limit(0).select(F.lit(None).cast("string").alias("metadata_schema_version"))
    else:
        version = F.col("metadata_schema_version")
        other = stations.where(~version.eqNullSafe(F.lit(C.METADATA_SCHEMA_VERSION))).select(version).distinct()
    return stations, other


def export_selection(selected: DataFrame, csv_path: str, ids_path: str, mode: str = "errorifexists") -> None:
    """Selected stations as CSV and their ids as JSON lines."""
    as_flat(selected).write.mode(mode).csv(csv_path, header=True, escape=CSV_QUOTE)
    selected.select("station_id").distinct().write.mode(mode).json(ids_path)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Station ids from JSON: lines with ``station_id``, one list of ids, or ``{"stations": [...]}``."""
    text = spark.read.text(path, wholetext=False).where(F.trim("value") != "")
    lines = text.select(F.get_json_object("value", "$.station_id").alias("station_id")).where(F.col("station_id").isNotNull())
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    kind = "array<string>"
    listed = whole.where(F.col("value").startswith("[")).select(F.explode(F.from_json("value", kind)).alias("station_id"))
    wrapped = F.get_json_object("value", "$.stations")
    named = whole.where(wrapped.isNotNull()).select(F.explode(F.from_json(wrapped, kind)).alias("station_id"))
    return lines.unionByName(listed).unionByName(named).distinct()


def save_results(metrics: DataFrame, path: str, file_format: str = "json", mode: str = "errorifexists") -> None:
    """Long metric table as JSON lines or parquet."""
    if file_format not in ("json", "parquet"):
        raise ValueError("file_format must be json or parquet")
    writer = metrics.write.mode(mode)
    if file_format == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)
