"""Station table: checks, clean names, enrichment, duplicates, selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .dominance import near_pairs


def _between(column: Column, limits) -> Column:
    return (column >= limits[0]) & (column <= limits[1])


def check_coordinates(stations: DataFrame) -> DataFrame:
    """Add ``coord_valid`` and ``coord_reasons`` (empty text when valid)."""
    lat, lon, height = F.col("latitude"), F.col("longitude"), F.col("elevation")
    reasons = F.concat_ws(
        ", ",
        F.when(lat.isNull(), "missing latitude").when(~_between(lat, C.LATITUDE_RANGE), "latitude out of range"),
        F.when(lon.isNull(), "missing longitude").when(~_between(lon, C.LONGITUDE_RANGE), "longitude out of range"),
        F.when((height != C.ELEVATION_UNKNOWN) & ~_between(height, C.ELEVATION_RANGE), "elevation out of range"),
    )
    return stations.withColumn("coord_reasons", reasons).withColumn("coord_valid", F.col("coord_reasons") == "")


def clean_name(name: Column) -> Column:
    """Trimmed, single blanks, every run of letters in title case."""
    single = F.trim(F.regexp_replace(name, r"\s+", " "))
    runs = F.regexp_extract_all(single, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_names(stations: DataFrame) -> DataFrame:
    return stations.withColumn("station_name", clean_name(F.col("station_name")))


def name_changes(stations: DataFrame) -> DataFrame:
    """The cleaning log: one row per station whose name changes."""
    cleaned = stations.select("station_id", F.col("station_name").alias("old_name"), clean_name(F.col("station_name")).alias("new_name"))
    return cleaned.where(~F.col("old_name").eqNullSafe(F.col("new_name")))


def attach_constants(df: DataFrame, stations: DataFrame, normalization: str = "none") -> DataFrame:
    """Coordinates of the station and the normalisation label on every row.

    The station table is not hinted: Spark broadcasts it when its size allows
    and otherwise splits a dominant station by itself in the sort-merge join.
    """
    facts = stations.select("station_id", "latitude", "longitude", "elevation")
    return df.join(facts, "station_id", "left").withColumn("normalization", F.lit(normalization))


def restrict_to(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("station_id").distinct(), "station_id", "left_semi")


def enrich_from_inventory(stations: DataFrame, inventory: DataFrame) -> DataFrame:
    """Fill missing coordinates and blank texts from the official station list."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    listed = inventory.select(
        "station_id",
        *[F.col(c).alias(f"inv_{c}") for c in ("latitude", "longitude", "elevation")],
        *[blank(F.regexp_replace(F.col(c), "\r", "")).alias(f"inv_{c}") for c in ("station_name", "state", "wmo_id", "icao_code")],
    )
    columns = stations.columns
    joined = stations.join(listed, "station_id", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"inv_{c}")) for c in ("latitude", "longitude", "elevation")}
    for c in ("station_name", "state", "wmo_id", "icao_code"):
        own = F.when(F.col(c) == "", None).otherwise(F.col(c)) if c in columns else F.lit(None).cast("string")
        filled[c] = F.coalesce(own, F.col(f"inv_{c}"))
    extra = [c for c in ("state", "wmo_id", "icao_code") if c not in columns]
    return joined.withColumns(filled).select(*columns, *extra)


# --- duplicates ---------------------------------------------------------------

STRATEGIES = ("prefer_longer", "prefer_recent")


def _preference(strategy: str) -> Column:
    """Larger is preferred; equal ones fall to the smaller id later on."""
    observations = F.coalesce(F.col("total_observation_count"), F.lit(0)).cast("bigint")
    if strategy == "prefer_longer":
        return F.struct(F.lit(None).cast("timestamp_ntz").alias("last"), observations.alias("n"))
    last = F.col("last_observation").cast("timestamp_ntz")
    return F.struct(last.alias("last"), F.when(last.isNull(), observations).alias("n"))


def _places(stations: DataFrame, strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    located = stations.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    ranked = located.select("station_id", "latitude", "longitude", _preference(strategy).alias("pref"))
    # Negated numbers make the preferred station the smallest, with ties to the smaller id.
    order = F.struct(
        F.when(F.col("pref.last").isNull(), 1).otherwise(0).alias("unknown"),
        (-F.unix_micros(F.col("pref.last").cast("timestamp"))).alias("last"),
        (-F.col("pref.n")).alias("n"),
        "station_id",
    )
    return ranked.groupBy("latitude", "longitude").agg(F.count("*").alias("n_stations"), F.min(order).alias("leader"))


def _celled(places: DataFrame, threshold: float) -> tuple[DataFrame, Column]:
    """Cells just under half the threshold wide: two places of touching cells are certainly near,
    places more than three cells apart certainly not."""
    width = F.lit(threshold * 0.4999)
    cells = {"cx": F.floor(F.col("latitude") / width), "cy": F.floor(F.col("longitude") / width)}
    return places.withColumns(cells), width


def _shifted(df: DataFrame, reach: int) -> DataFrame:
    """Each row once per cell (tx, ty) around its own."""
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    moved = df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return moved.withColumns({"tx": F.col("cx") + F.col("dx"), "ty": F.col("cy") + F.col("dy")})


def _within_reach_of_cell(celled: DataFrame, width: Column, threshold: float, *columns: str) -> DataFrame:
    """Places two or three cells away from a cell (cx, cy) that may still be near some place in it."""
    reach = F.lit(threshold * 1.0001)
    return (
        _shifted(celled.select("latitude", "longitude", *columns, "cx", "cy"), 3)
        .where(F.greatest(F.abs("dx"), F.abs("dy")) >= 2)
        .where(F.col("latitude").between(F.col("tx") * width - reach, (F.col("tx") + 1) * width + reach))
        .where(F.col("longitude").between(F.col("ty") * width - reach, (F.col("ty") + 1) * width + reach))
        .select(
            F.col("tx").alias("cx"),
            F.col("ty").alias("cy"),
            "dx",
            "dy",
            *[F.col(c).alias(f"o_{c}") for c in ("latitude", "longitude", *columns)],
        )
    )


def _near(threshold: float) -> Column:
    return (F.abs(F.col("latitude") - F.col("o_latitude")) <= threshold) & (
        F.abs(F.col("longitude") - F.col("o_longitude")) <= threshold
    )


def _best_within_reach(places: DataFrame, threshold: float) -> DataFrame:
    """``best``: the most preferred station within ``threshold`` of each place.

    One row per cell stands for all places of the touching cells. Of the places two
    or three cells away only those preferred over the best already known to the cell
    take part in exact distances, which leaves a handful even where many places
    crowd into one cell.
    """
    celled, width = _celled(places, threshold)
    cells = celled.groupBy("cx", "cy").agg(F.min("leader").alias("best"))
    known = _shifted(cells, 1).groupBy(F.col("tx").alias("cx"), F.col("ty").alias("cy")).agg(F.min("best").alias("known"))
    outer = (
        _within_reach_of_cell(celled, width, threshold, "leader")
        .join(known, ["cx", "cy"])
        .where(F.col("o_leader") < F.col("known"))
        .drop("known")
    )
    farther = (
        celled.join(outer, ["cx", "cy"])
        .where(_near(threshold))
        .groupBy("latitude", "longitude")
        .agg(F.min("o_leader").alias("farther"))
    )
    return (
        celled.join(known, ["cx", "cy"])
        .join(farther, ["latitude", "longitude"], "left")
        .select("latitude", "longitude", F.least("known", "farther").alias("best"))
    )


def duplicate_stations(stations: DataFrame, threshold: float = 0.01, strategy: str = "prefer_longer") -> DataFrame:
    """One row per station that a better one stands for.

    ``duplicate_of`` is the most preferred station within ``threshold`` degrees.
    Listing every pair would grow with the square of the copies at one place;
    :func:`duplicate_pair_count` gives their exact number instead.
    """
    best = _best_within_reach(_places(stations, strategy), threshold)
    own = stations.select("station_id", "latitude", "longitude")
    positions = stations.select(F.col("station_id").alias("p_id"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    reason = F.format_string(
        "same_location (dist: %.4f, %.4f)",
        F.abs(F.col("latitude") - F.col("p_lat")),
        F.abs(F.col("longitude") - F.col("p_lon")),
    )
    losers = (
        own.join(best, ["latitude", "longitude"])
        .withColumn("p_id", F.col("best.station_id"))
        .where(F.col("station_id") != F.col("p_id"))
    )
    return losers.join(positions, "p_id").select(
        "station_id", F.col("p_id").alias("duplicate_of"), F.lit(0.9).alias("confidence_score"), reason.alias("reason")
    )


def duplicate_pair_count(stations: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Number of station pairs within the threshold, counted without listing or comparing them.

    Pairs of one cell or of touching cells follow from the cells' counts. Places two or three
    cells apart meet by pair of cells and are counted by range (``dominance``), which takes n log² n
    steps for n places, however many of them crowd into a cell.
    """
    celled, width = _celled(_places(stations, "prefer_longer"), threshold)
    cells = celled.groupBy("cx", "cy").agg(F.sum("n_stations").alias("c"))
    half = (F.col("dx") > 0) | ((F.col("dx") == 0) & (F.col("dy") > 0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias("n")
    inside = cells.agg(total(F.col("c") * (F.col("c") - 1) / 2))
    beside = _shifted(cells, 1).where(half).select(F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("c").alias("o_c"))
    touching = cells.join(beside, ["cx", "cy"]).agg(total(F.col("c") * F.col("o_c")))
    apart = _far_cell_pairs(celled, width, threshold).agg(total("n"))
    return inside.unionByName(touching).unionByName(apart).agg(F.sum("n").alias("duplicate_pairs"))


def _far_cell_pairs(celled: DataFrame, width: Column, threshold: float) -> DataFrame:
    """Near pairs of places two or three cells apart, counted per task: ``n``."""
    reach = F.lit(threshold * 1.0001)
    far = [(dx, dy) for dx in range(4) for dy in range(-3, 4) if max(abs(dx), abs(dy)) >= 2 and (dx > 0 or dy > 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in far]))
    sides = []
    for name, sign in (("a", 1), ("b", -1)):
        moved = celled.select("latitude", "longitude", "n_stations", "cx", "cy", steps.alias("s")).select("*", "s.dx", "s.dy")
        other = {"tx": F.col("cx") + sign * F.col("dx"), "ty": F.col("cy") + sign * F.col("dy")}
        # Only places that may be near some place of the other cell.
        close = moved.withColumns(other).where(
            F.col("latitude").between(F.col("tx") * width - reach, (F.col("tx") + 1) * width + reach)
            & F.col("longitude").between(F.col("ty") * width - reach, (F.col("ty") + 1) * width + reach)
        )
        at = ("cx", "cy") if sign == 1 else ("tx", "ty")
        sides.append(
            close.select(F.col(at[0]).alias("gx"), F.col(at[1]).alias("gy"), "dx", "dy", F.lit(name).alias("side"), "latitude", "longitude", "n_stations")
        )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts) if parts else None
        if rows is None or not len(rows):
            return
        group = rows.groupby(["gx", "gy", "dx", "dy"]).ngroup().to_numpy()
        direction = rows[["dx", "dy"]].to_numpy()
        # Turned so that side b has the larger values; distances stay exactly what they are.
        points = rows[["latitude", "longitude"]].to_numpy() * np.where(direction < 0, -1.0, 1.0)
        is_a, weight = (rows["side"] == "a").to_numpy(), rows["n_stations"].to_numpy()
        found = near_pairs(
            group[is_a], points[is_a], weight[is_a], group[~is_a], points[~is_a], weight[~is_a], np.abs(direction[is_a]) >= 2, threshold
        )
        yield pd.DataFrame({"n": [found]})

    met = sides[0].unionByName(sides[1]).repartition("gx", "gy", "dx", "dy")
    return met.mapInPandas(count, "n bigint")


def attach_label(stations: DataFrame, labels: DataFrame, name: str = "cluster") -> DataFrame:
    """Add the label of each station, NULL where it has none; of several the smallest, so no station is repeated."""
    one = labels.groupBy("station_id").agg(F.min(name).alias(name))
    return stations.drop(name).join(one, "station_id", "left")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name; a column that a table lacks is NULL, one that differs in type is refused."""
    kinds: dict[str, str] = {}
    for table in tables:
        for name, kind in table.dtypes:
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"column {name} is {kinds[name]} in one table and {kind} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_counts(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """How many different values columns have; ``columns`` maps them to the names of the counts. NULL is no value.

    Counted in two steps, column by column, so that no task holds all values of one.
    """
    cells = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    each = table.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()).distinct()
    found = each.groupBy("name").agg(F.count("*").alias("n"))
    counted = [F.coalesce(F.max(F.when(F.col("name") == c, F.col("n"))), F.lit(0)).alias(n) for c, n in columns.items()]
    return found.agg(*counted)


def drop_duplicates(stations: DataFrame, duplicates: DataFrame) -> DataFrame:
    return stations.join(duplicates.select("station_id").distinct(), "station_id", "left_anti")


def clean_stations(stations: DataFrame, threshold: float = 0.01, strategy: str = "prefer_longer") -> DataFrame:
    """Duplicates merged, coordinates checked, names cleaned."""
    merged = drop_duplicates(stations, duplicate_stations(stations, threshold, strategy))
    return clean_names(check_coordinates(merged))


def cleaning_report(stations: DataFrame, threshold: float = 0.01, strategy: str = "prefer_longer") -> DataFrame:
    """One row of counters for a cleaning run."""
    merged = drop_duplicates(stations, duplicate_stations(stations, threshold, strategy))
    before = stations.agg(F.count("*").alias("original_station_count"))
    cleaned = clean_name(F.col("station_name"))
    after = check_coordinates(merged).agg(
        F.count("*").alias("cleaned_station_count"),
        F.count_if("coord_valid").alias("coordinates_validated"),
        F.count_if(~F.col("coord_valid")).alias("coordinates_invalid"),
        F.count_if(~F.col("station_name").eqNullSafe(cleaned)).alias("names_cleaned"),
    )
    # Three one-row tables side by side.
    return (
        before.crossJoin(after)
        .crossJoin(duplicate_pair_count(stations, threshold))
        .withColumn("removed_station_count", F.col("original_station_count") - F.col("cleaned_station_count"))
    )


# --- selection ----------------------------------------------------------------


@dataclass(frozen=True)
class StationCriteria:
    """Limits a station has to meet; ``None`` switches a limit off."""

    min_temperature_completeness_pct: float | None = None
    min_dew_point_temperature_completeness_pct: float | None = None
    min_sea_level_pressure_completeness_pct: float | None = None
    min_wind_direction_completeness_pct: float | None = None
    min_wind_speed_completeness_pct: float | None = None
    min_relative_humidity_completeness_pct: float | None = None
    min_years: int | None = None
    min_observations: int | None = None
    latitude: tuple[float, float] | None = None
    longitude: tuple[float, float] | None = None
    max_gap_hours: float | None = None
    require_valid_coordinates: bool = False

    def rule(self) -> Column:
        keep = F.lit(True)
        for field in fields(self):
            limit = getattr(self, field.name)
            if field.name.endswith("_completeness_pct") and limit is not None:
                keep = keep & (F.col(field.name.removeprefix("min_")) >= limit)
        if self.min_years is not None:
            keep = keep & (F.size("years_available") >= self.min_years)
        if self.min_observations is not None:
            keep = keep & (F.col("total_observation_count") >= self.min_observations)
        if self.latitude is not None:
            keep = keep & _between(F.col("latitude"), self.latitude)
        if self.longitude is not None:
            keep = keep & _between(F.col("longitude"), self.longitude)
        if self.max_gap_hours is not None:
            keep = keep & (F.col("max_gap_duration_hours") <= self.max_gap_hours)
        if self.require_valid_coordinates:
            keep = keep & F.col("coord_valid") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        return F.coalesce(keep, F.lit(False))


def select_stations(stations: DataFrame, criteria: StationCriteria) -> DataFrame:
    return stations.where(criteria.rule())


def selection_summary(stations: DataFrame, criteria: StationCriteria) -> DataFrame:
    kept = F.count_if(criteria.rule())
    return stations.agg(F.count("*").alias("total"), kept.alias("kept")).select(
        "total",
        "kept",
        (F.col("total") - F.col("kept")).alias("removed"),
        F.try_divide(F.col("kept") * F.lit(100.0), F.col("total")).alias("kept_pct"),
    )


def best_stations(
    stations: DataFrame, country: str | None = "US", n: int = 10, min_completeness: float = 80.0, min_years: int = 10
) -> DataFrame:
    """The ``n`` most complete stations with enough temperature data, enough years and valid coordinates."""
    good = select_stations(
        stations,
        StationCriteria(min_temperature_completeness_pct=min_completeness, min_years=min_years, require_valid_coordinates=True),
    )
    if country is not None:
        good = good.where(F.col("country_code") == country)
    return good.orderBy(F.col("temperature_completeness_pct").desc(), "station_id").limit(n)
