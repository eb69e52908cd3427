"""Raw reports: selecting columns, rejecting values, dropping summaries.

Columns carry the lower-case names given by :mod:`stationfill.sources.observations`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import reports as R


KEYS = ("station_id", "ts", "year", "report_type")


def select_variables(df: DataFrame, variables=C.TIER1_VARIABLES) -> DataFrame:
    """The keys that reading gives, primary columns and every attribute of ``variables`` that the table has."""
    present = {name.lower(): name for name in df.columns}
    primary = [name.lower() for name in C.PRIMARY_COLUMNS]
    wanted = [*KEYS, *(name for name in primary if name not in KEYS)]
    for variable in variables:
        wanted += [f"{variable}{suffix}".lower() for suffix in C.ATTRIBUTE_SUFFIXES]
        wanted.append(f"{variable}_report_type")
    return df.select(*[present[name] for name in wanted if name in present])


def blank_flagged_values(
    df: DataFrame, variables=C.TIER1_VARIABLES, erroneous: bool = True, suspect: bool = False
) -> DataFrame:
    """NULL the values whose quality code marks them; rows and codes stay."""
    present = {name.lower() for name in df.columns}
    changes = {
        variable: R.blank_flagged(F.col(variable), F.col(f"{variable}_quality_code"), erroneous, suspect)
        for variable in variables
        if variable in present and f"{variable}_quality_code" in present
    }
    return df.withColumns(changes) if changes else df


def keep_by_quality(df: DataFrame, code_column: str, valid: bool = True) -> DataFrame:
    """Rows with a valid code (or, with ``valid=False``, a known bad one)."""
    if code_column.lower() not in {name.lower() for name in df.columns}:
        return df if valid else df.where(F.lit(False))
    kind = df.schema[code_column].dataType
    rule = R.valid_code if valid else R.invalid_code
    return df.where(rule(F.col(code_column), kind))


def keep_hourly(df: DataFrame, report_type: str = "report_type") -> DataFrame:
    if report_type not in df.columns:
        return df
    return df.where(R.is_hourly_report(F.col(report_type)))


def keep_report_types(df: DataFrame, allowed=("AUTO", "FM-15"), report_type: str = "report_type") -> DataFrame:
    return df.where(F.col(report_type).isin(*allowed))


def unify_timestamps(df: DataFrame, into: str = "ts") -> DataFrame:
    """One timestamp from a typed or text date, else from the date parts."""
    present = {name.lower() for name in df.columns}
    options = []
    if "date" in present:
        text = df.schema[[n for n in df.columns if n.lower() == "date"][0]].dataType.typeName() == "string"
        options.append(R.parsed_timestamp(F.col("date")) if text else F.col("date").cast("timestamp_ntz"))
    parts = ("year", "month", "day", "hour", "minute")
    if all(part in present for part in parts):
        options.append(R.timestamp_from_parts(*[F.col(part) for part in parts]))
    if not options:
        return df.withColumn(into, F.lit(None).cast("timestamp_ntz"))
    return df.withColumn(into, F.coalesce(*options))


def keep_prefixes(df: DataFrame, prefixes=C.NORTH_AMERICA_PREFIXES, id_column: str = "station_id") -> DataFrame:
    rule = reduce(lambda a, b: a | b, [F.col(id_column).startswith(p) for p in prefixes])
    return df.where(rule)

