"""Station metadata from raw reports: one grouped pass per kind of summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import reports as R
from . import day_states as S


def report_type_counts(df: DataFrame, key: str = "station_id", report_type: str = "report_type") -> DataFrame:
    """Long form ``(station_id, report_type, n)``; a missing type counts as ``"null"``."""
    return df.groupBy(key, F.coalesce(F.col(report_type), F.lit("null")).alias("report_type")).agg(F.count("*").alias("n"))


def year_counts(df: DataFrame, key: str = "station_id") -> DataFrame:
    """Long form ``(station_id, year, n)`` over reports with a timestamp."""
    dated = df.where(F.col("ts").isNotNull())
    return dated.groupBy(key, F.year("ts").alias("year")).agg(F.count("*").alias("n"))


def completeness_pct(df: DataFrame, variable: str, rows: Column | None = None) -> Column:
    """Aggregate: share of rows with a valid value; 0 without rows or without the column."""
    if variable not in {name.lower() for name in df.columns}:
        return F.lit(0.0)
    rows = F.lit(True) if rows is None else rows
    return F.coalesce(F.try_divide(F.count_if(rows & S.valid(df, variable)) * F.lit(100.0), F.count_if(rows)), F.lit(0.0))


def variable_stats(df: DataFrame, variables, key: str = "station_id") -> DataFrame:
    """Long form, one row per station and variable: counts, completeness and moments of valid values.

    All variables come out of one aggregation and are unfolded afterwards.
    """
    aggregates = []
    for v in variables:
        good = F.when(S.valid(df, v), F.col(v))
        aggregates.append(
            F.struct(
                F.lit(v).alias("variable"),
                F.count("*").alias("n"),
                F.count(good).alias("n_valid"),
                F.count_if(F.col(v).isNull()).alias("n_null"),
                completeness_pct(df, v).alias("completeness_pct"),
                F.avg(good).alias("mean"),
                F.stddev_samp(good).alias("std"),
                F.min(good).alias("min"),
                F.max(good).alias("max"),
            ).alias(v)
        )
    grouped = df.groupBy(key).agg(*aggregates)
    return grouped.select(key, F.inline(F.array(*variables)))


def coverage(df: DataFrame, key: str = "station_id") -> DataFrame:
    """First and last report and the years seen, over hourly reports; totals over all."""
    hourly = R.is_hourly_report(F.col("report_type"))
    return df.groupBy(key).agg(
        F.count("*").alias("total_records_all_types"),
        F.count_if(~hourly).alias("records_excluded_by_filter"),
        F.count_if(hourly).alias("total_observation_count"),
        F.min(F.when(hourly, F.col("ts"))).alias("first_observation"),
        F.max(F.when(hourly, F.col("ts"))).alias("last_observation"),
        F.sort_array(F.collect_set(F.year("ts"))).alias("years_available"),
    )


def gap_analysis(df: DataFrame, key: str = "station_id", ts: str = "ts") -> DataFrame:
    """Gaps between consecutive reports of a station.

    Reports of a station and day are combined before they are shuffled. Instants meet only within
    their day, and days meet through their first and last instant, so no task holds a whole station.
    """
    at = F.col(ts).cast("timestamp")
    days = df.groupBy(key, F.to_date(at).alias("__day")).agg(
        F.count("*").alias("__n"), S.instants_of(F.unix_micros(at)).alias("__instants")
    )
    own = S.steps(F.col("__instants"))
    ends = days.select(
        key,
        "__day",
        "__n",
        F.try_element_at("__instants", F.lit(1)).alias("__lo"),
        F.try_element_at("__instants", F.lit(-1)).alias("__hi"),
        F.coalesce(F.array_max(own), F.lit(0)).alias("__longest"),
        S.total(own).alias("__sum"),
    )
    # Dated days in order, reports without a time after them: these have no instants, so no step reaches them.
    by_day = Window.partitionBy(key).orderBy(F.col("__day").asc_nulls_last())
    dated = F.when(F.col("__day").isNotNull(), F.col("__n"))
    seconds = lambda late, early: F.floor((late - early) / F.lit(1_000_000))
    joined = ends.withColumn("__step", seconds(F.col("__lo"), F.lag("__hi").over(by_day)))
    hour = F.lit(3600.0)
    gaps = joined.groupBy(key).agg(
        F.count_if(F.col("__step") > 24 * 3600).alias("gap_count_24h"),
        (F.greatest(F.max("__longest"), F.coalesce(F.max("__step"), F.lit(0))) / hour).alias("max_gap_hours"),
        F.try_divide((F.sum("__sum") + F.coalesce(F.sum("__step"), F.lit(0))) / hour, F.sum(dated) - 1).alias("avg_interval_hours"),
        (F.floor(seconds(F.max("__hi"), F.min("__lo")) / hour) + 1).alias("expected_observations"),
        F.sum(dated).alias("__dated"),
        F.sum("__n").alias("total_observations"),
    )
    several = F.coalesce(F.col("__dated"), F.lit(0)) >= 2
    zero_unless = lambda c, zero: F.when(several, F.col(c)).otherwise(F.lit(zero)).alias(c)
    return gaps.select(
        key,
        zero_unless("gap_count_24h", 0),
        zero_unless("max_gap_hours", 0.0),
        zero_unless("avg_interval_hours", 0.0),
        "total_observations",
        zero_unless("expected_observations", 0),
    )


# Layout of the station table, in writing order.
STATION_COLUMNS = (
    "station_id",
    "country_code",
    "station_name",
    "latitude",
    "longitude",
    "elevation",
    "state",
    "wmo_id",
    "icao_code",
    "report_type_counts",
    "total_records_all_types",
    "records_excluded_by_filter",
    "first_observation",
    "last_observation",
    "years_available",
    "total_observation_count",
    "year_counts",
    *sorted(f"{v}_completeness_pct" for v in C.ALL_VARIABLES),
    "temperature_stats",
    "dew_point_stats",
    "sea_level_pressure_stats",
    "gap_count_24h",
    "max_gap_duration_hours",
    "avg_observation_interval_hours",
    "metadata_computed_at",
    "metadata_schema_version",
)


def station_metadata(reports: DataFrame, hourly_only: bool = True, computed_at: Column | None = None) -> DataFrame:
    """The station table from raw reports of all stations at once.

    Stations whose reports are all summaries stay, with zeros and NULLs.
    """
    return metadata_of_states(S.day_states(reports, hourly_only), computed_at)


def metadata_of_states(states: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """The station table from states that have each day of a station once."""
    whole = S.station_totals(states)
    rows = F.col("n_hourly")
    # Without hourly reports there is nothing to have gaps.
    unless_none = lambda c: F.when(rows > 0, F.col(c))

    def stats(variable: str, parts) -> Column:
        m = F.col(f"moments_{variable}")
        shown = {"min": m["min"], "max": m["max"], "mean": m["mean"], "std": F.sqrt(F.try_divide(m["m2"], F.when(m["n"] > 1, m["n"] - 1)))}
        return F.struct(*[shown[p].alias(p) for p in parts])

    return whole.withColumns(
        {
            "country_code": F.substring("station_id", 1, 2),
            "state": F.lit(None).cast("string"),
            "wmo_id": F.lit(None).cast("string"),
            "icao_code": F.lit(None).cast("string"),
            "station_name": F.coalesce(F.col("station_name.x"), F.lit("")),
            **{c: F.col(f"{c}.x") for c in ("latitude", "longitude", "elevation")},
            "report_type_counts": F.map_from_entries("types"),
            "total_records_all_types": F.col("n"),
            "records_excluded_by_filter": F.col("n") - rows,
            "first_observation": F.col("first"),
            "last_observation": F.col("last"),
            "years_available": F.sort_array("years"),
            "total_observation_count": rows,
            **{
                f"{v}_completeness_pct": F.coalesce(F.try_divide(F.col(f"valid_{v}") * F.lit(100.0), rows), F.lit(0.0))
                for v in C.ALL_VARIABLES
            },
            "temperature_stats": stats("temperature", S.STATS["temperature"]),
            "dew_point_stats": stats("dew_point_temperature", S.STATS["dew_point_temperature"]),
            "sea_level_pressure_stats": stats("sea_level_pressure", S.STATS["sea_level_pressure"]),
            "max_gap_duration_hours": unless_none("max_gap_hours"),
            "avg_observation_interval_hours": unless_none("avg_interval_hours"),
            "metadata_computed_at": (F.current_timestamp() if computed_at is None else computed_at).cast("timestamp_ntz"),
            "metadata_schema_version": F.lit(C.METADATA_SCHEMA_VERSION),
        }
    ).select(*STATION_COLUMNS)


def metadata_summary(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.count("*").alias("total_stations"),
        F.avg("total_observation_count").alias("avg_observations"),
        F.sum("total_observation_count").alias("total_observations"),
        F.avg("temperature_completeness_pct").alias("avg_temperature_completeness"),
        F.count_if(F.col("temperature_completeness_pct") > 90).alias("stations_over_90_pct"),
        F.count_if(F.col("total_observation_count") == 0).alias("stations_without_hourly"),
    )


def cluster_stats(stations: DataFrame) -> DataFrame:
    return (
        stations.where(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(
            F.count("*").alias("station_count"),
            F.avg("temperature_completeness_pct").alias("avg_temp_completeness"),
            F.avg("total_observation_count").alias("avg_observations"),
            F.avg("latitude").alias("centroid_lat"),
            F.avg("longitude").alias("centroid_lon"),
        )
        .orderBy("cluster")
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin is closed.

    Rows of one value are counted first; range and bins are both made from these counts.
    The range is one row, so attaching it copies no data.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    limits = counted.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    position = F.least(F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1))
    return (
        counted.crossJoin(F.broadcast(limits))
        .groupBy(position.alias("bin"), (F.col("lo") + position * width).alias("bin_start"))
        .agg(F.sum("__n").alias("n"))
    )


def edge_histogram(df: DataFrame, value: str, edges) -> DataFrame:
    """Bins between given edges, each open on the right except the last; values outside are left out."""
    edges = [float(e) for e in edges]
    label = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        inside = (F.col(value) >= low) & ((F.col(value) <= high) if i == len(edges) - 2 else (F.col(value) < high))
        label = F.when(inside, i) if label is None else label.when(inside, i)
    return df.select(label.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("n"))


# --- incremental update -------------------------------------------------------


def update_status(stations: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """``(station_id, status)`` with status new, changed or unchanged.

    ``files`` has ``station_id`` and ``modified_at`` per file; a station without
    files keeps what it has.
    """
    latest = files.groupBy("station_id").agg(F.max("modified_at").alias("latest"))
    known = existing.select("station_id", "metadata_computed_at", F.lit(True).alias("__known"))
    status = (
        F.when(F.col("__known").isNull(), "new")
        .when(F.col("metadata_computed_at").isNull(), "changed")
        .when(F.col("latest") > F.col("metadata_computed_at"), "changed")
        .otherwise("unchanged")
    )
    joined = stations.select("station_id").distinct().join(known, "station_id", "left").join(latest, "station_id", "left")
    return joined.select("station_id", status.alias("status"))


def merge_metadata(existing: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recomputed stations replace their old rows."""
    kept = existing.join(recomputed.select("station_id"), "station_id", "left_anti")
    return kept.unionByName(recomputed, allowMissingColumns=True)


def update_metadata(reports: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """Recompute only the stations whose files are new or changed."""
    stale = update_status(files, files, existing).where(F.col("status") != "unchanged")
    wanted = reports.join(stale.select("station_id"), "station_id", "left_semi")
    return merge_metadata(existing, station_metadata(wanted))
