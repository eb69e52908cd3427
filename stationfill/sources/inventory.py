"""The official station list, the country list and counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C

# Layout of the station list, and the texts that mean "not given".
INVENTORY_FIELDS = (
    ("GHCN_ID", "station_id", "string"),
    ("LATITUDE", "latitude", "double"),
    ("LONGITUDE", "longitude", "double"),
    ("ELEVATION", "elevation", "double"),
    ("STATE", "state", "string"),
    ("NAME", "station_name", "string"),
    ("GSN", "gsn", "string"),
    ("(US)HCN_(US)CRN", "hcn_crn", "string"),
    ("WMO_ID", "wmo_id", "string"),
    ("ICAO", "icao_code", "string"),
)
NOT_GIVEN = ("", "NA", "N/A")


def tidy_inventory(raw: DataFrame) -> DataFrame:
    """Known columns under our names, texts trimmed, "not given" as NULL."""
    present = {name.strip(): name for name in raw.columns}
    columns = []
    for name, ours, kind in INVENTORY_FIELDS:
        if name not in present:
            continue
        column = F.col(f"`{present[name]}`")
        if kind == "string" and isinstance(raw.schema[present[name]].dataType, T.StringType):
            column = F.regexp_replace(column, r"^\s+|\s+$", "")
            column = F.when(~column.isin(*NOT_GIVEN), column)
        columns.append(column.alias(ours))
    return raw.select(*columns)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is read as text, numbers that cannot be read become NULL."""
    tidy = tidy_inventory(spark.read.csv(path, header=True, inferSchema=False))
    numbers = {ours: F.col(ours).try_cast("double") for _, ours, kind in INVENTORY_FIELDS if kind == "double" and ours in tidy.columns}
    return tidy.withColumns(numbers)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width text: two-letter code, blanks, name from column 13."""
    lines = spark.read.text(path).where(F.col("value").rlike("^[A-Z]{2} "))
    return lines.select(F.substring("value", 1, 2).alias("country_code"), F.trim(F.substring("value", 13, 200)).alias("country_name"))


def country_counts(stations: DataFrame, id_column: str = "station_id") -> DataFrame:
    """Stations per country code and whether it is in the North America subset."""
    code = F.substring(F.col(id_column), 1, 2)
    return (
        stations.where(F.length(id_column) >= 2)
        .groupBy(code.alias("country_code"))
        .agg(F.count("*").alias("n_stations"))
        .withColumn("north_america", F.col("country_code").isin(*C.NORTH_AMERICA_PREFIXES))
    )


def country_report(stations: DataFrame, countries: DataFrame | None = None, top: int = 10, id_column: str = "station_id") -> DataFrame:
    """The subset's countries and the ``top`` others, largest first within each block."""
    counts = country_counts(stations, id_column)
    ours = counts.where("north_america")
    others = counts.where(~F.col("north_america")).orderBy(F.col("n_stations").desc(), "country_code").limit(top)
    report = ours.unionByName(others)
    if countries is not None:
        report = report.join(countries, "country_code", "left")
    return report.orderBy(F.col("north_america").desc(), F.col("n_stations").desc(), "country_code")
