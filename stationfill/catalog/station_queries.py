"""The station table: checks, cleaning, duplicates, enrichment, selection, splits, file audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, metadata, reports, splits, stations
from ..sources import inventory, manifest
from .registry import query
from .views import FILES, INVENTORY, STATIONS

VALID_ELEVATION = "(elevation IS NULL OR elevation = -999.9::DOUBLE OR (elevation >= -500 AND elevation <= 9000))"
VALID_COORDINATES = (
    "(latitude IS NOT NULL AND longitude IS NOT NULL AND latitude >= -90 AND latitude <= 90 "
    f"AND longitude >= -180 AND longitude <= 180 AND {VALID_ELEVATION})"
)
CLEAN_NAME = (
    "array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(station_name, '\\s+', ' ', 'g')), '[A-Za-z]+|[^A-Za-z]+'), "
    "lambda x: upper(x[1]) || lower(x[2:])), '')"
)


@query(
    "check_coordinates",
    f"""WITH {STATIONS} SELECT station_id, {VALID_COORDINATES} AS coord_valid,
          concat_ws(', ', CASE WHEN latitude IS NULL THEN 'missing latitude' END, CASE WHEN longitude IS NULL THEN 'missing longitude' END,
                    CASE WHEN NOT {VALID_ELEVATION} THEN 'elevation out of range' END) AS coord_reasons FROM stations""",
)
def _(v):
    return stations.check_coordinates(v.stations()).select("station_id", "coord_valid", "coord_reasons")


@query("clean_names", f"WITH {STATIONS} SELECT station_id, {CLEAN_NAME} AS station_name FROM stations")
def _(v):
    return stations.clean_names(v.stations()).select("station_id", "station_name")


@query(
    "name_changes",
    f"""WITH {STATIONS}, n AS (SELECT station_id, station_name AS old_name, {CLEAN_NAME} AS new_name FROM stations)
        SELECT * FROM n WHERE old_name IS DISTINCT FROM new_name""",
)
def _(v):
    return stations.name_changes(v.stations())


@query(
    "attach_station_constants",
    f"""WITH {STATIONS} SELECT o_orderkey, station_id, latitude, longitude, elevation, 'zscore' AS normalization
        FROM orders LEFT JOIN stations ON station_id = o_custkey""",
)
def _(v):
    rows = v.table("orders").select("o_orderkey", F.col("o_custkey").alias("station_id"))
    return stations.attach_constants(rows, v.stations(), "zscore")


@query("north_america_stations", f"WITH {STATIONS} SELECT code FROM stations WHERE left(code, 2) IN ('US', 'CA', 'MX', 'RQ', 'VQ')")
def _(v):
    return reports.keep_prefixes(v.stations(), id_column="code").select("code")


@query(
    "restrict_to_selected",
    f"WITH {STATIONS} SELECT station_id, station_name FROM stations WHERE station_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
)
def _(v):
    picked = v.table("orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("station_id"))
    return stations.restrict_to(v.stations(), picked).select("station_id", "station_name")


@query(
    "enrich_from_inventory",
    f"""WITH {STATIONS}, {INVENTORY} SELECT s.station_id, coalesce(s.latitude, i.latitude) AS latitude, coalesce(s.longitude, i.longitude) AS longitude,
          coalesce(CASE WHEN s.station_id % 10 = 0 THEN NULL ELSE s.elevation END, i.elevation) AS elevation,
          coalesce(nullif(CASE WHEN s.station_id % 7 = 0 THEN '' ELSE s.station_name END, ''), i.station_name) AS station_name,
          i.state, i.wmo_id, i.icao_code
        FROM stations s LEFT JOIN inventory i USING (station_id)""",
)
def _(v):
    known = v.stations().select(
        "station_id",
        "latitude",
        "longitude",
        F.when(F.col("station_id") % 10 != 0, F.col("elevation")).alias("elevation"),
        F.when(F.col("station_id") % 7 == 0, "").otherwise(F.col("station_name")).alias("station_name"),
    )
    return stations.enrich_from_inventory(known, v.inventory())


@query("tidy_inventory", f"WITH {INVENTORY} SELECT * FROM inventory")
def _(v):
    return v.inventory()


_DUPLICATES = """pairs AS (
  SELECT a.station_id, b.station_id AS other, a.latitude, a.longitude, b.latitude AS lat2, b.longitude AS lon2,
         row_number() OVER (PARTITION BY a.station_id ORDER BY {order}, b.station_id) AS r
  FROM stations a JOIN stations b ON abs(a.latitude - b.latitude) <= {thr}::DOUBLE AND abs(a.longitude - b.longitude) <= {thr}::DOUBLE),
duplicates AS (SELECT station_id, other AS duplicate_of, 0.9::DOUBLE AS confidence_score,
  printf('same_location (dist: %.4f, %.4f)', abs(latitude - lat2), abs(longitude - lon2)) AS reason
  FROM pairs WHERE r = 1 AND station_id <> other)"""
_LONGER = "b.total_observation_count DESC"
_RECENT = "b.last_observation DESC NULLS LAST, CASE WHEN b.last_observation IS NULL THEN b.total_observation_count END DESC"


@query("duplicates_prefer_longer", f"WITH {STATIONS}, {_DUPLICATES.format(order=_LONGER, thr=0.01)} SELECT * FROM duplicates")
def _(v):
    return stations.duplicate_stations(v.stations())


@query("duplicates_prefer_recent", f"WITH {STATIONS}, {_DUPLICATES.format(order=_RECENT, thr=0.2)} SELECT * FROM duplicates")
def _(v):
    return stations.duplicate_stations(v.stations(), threshold=0.2, strategy="prefer_recent")


@query(
    "duplicate_pair_count",
    f"""WITH {STATIONS} SELECT count(*) AS duplicate_pairs FROM stations a JOIN stations b
        ON abs(a.latitude - b.latitude) <= 0.2::DOUBLE AND abs(a.longitude - b.longitude) <= 0.2::DOUBLE AND a.station_id < b.station_id""",
)
def _(v):
    return stations.duplicate_pair_count(v.stations(), threshold=0.2)


@query(
    "drop_duplicate_stations",
    f"""WITH {STATIONS}, {_DUPLICATES.format(order=_LONGER, thr=0.01)}
        SELECT station_id, station_name FROM stations WHERE station_id NOT IN (SELECT station_id FROM duplicates)""",
)
def _(v):
    table = v.stations()
    return stations.drop_duplicates(table, stations.duplicate_stations(table)).select("station_id", "station_name")


@query(
    "clean_stations",
    f"""WITH {STATIONS}, {_DUPLICATES.format(order=_LONGER, thr=0.01)}
        SELECT station_id, {CLEAN_NAME} AS station_name, {VALID_COORDINATES} AS coord_valid FROM stations
        WHERE station_id NOT IN (SELECT station_id FROM duplicates)""",
)
def _(v):
    return stations.clean_stations(v.stations()).select("station_id", "station_name", "coord_valid")


@query(
    "cleaning_report",
    f"""WITH {STATIONS}, {_DUPLICATES.format(order=_LONGER, thr=0.01)},
        kept AS (SELECT *, {CLEAN_NAME} AS new_name, {VALID_COORDINATES} AS ok FROM stations WHERE station_id NOT IN (SELECT station_id FROM duplicates))
        SELECT (SELECT count(*) FROM stations) AS original_station_count, count(*) AS cleaned_station_count,
          count(*) FILTER (ok) AS coordinates_validated, count(*) FILTER (NOT ok) AS coordinates_invalid,
          count(*) FILTER (new_name IS DISTINCT FROM station_name) AS names_cleaned,
          (SELECT count(*) FROM pairs WHERE station_id < other) AS duplicate_pairs,
          (SELECT count(*) FROM stations) - count(*) AS removed_station_count FROM kept""",
)
def _(v):
    return stations.cleaning_report(v.stations())


@query(
    "select_stations",
    f"""WITH {STATIONS} SELECT station_id, {VALID_COORDINATES} AS coord_valid FROM stations
        WHERE temperature_completeness_pct >= 30 AND n_years >= 4 AND total_observation_count >= 8 AND {VALID_COORDINATES}""",
)
def _(v):
    criteria = stations.StationCriteria(
        min_temperature_completeness_pct=30, min_years=4, min_observations=8, require_valid_coordinates=True
    )
    return stations.select_stations(stations.check_coordinates(v.stations()), criteria).select("station_id", "coord_valid")


@query(
    "selection_summary",
    f"""WITH {STATIONS}, k AS (SELECT count(*) AS total, count(*) FILTER (temperature_completeness_pct >= 30 AND n_years >= 4) AS kept FROM stations)
        SELECT total, kept, total - kept AS removed, round(100.0::DOUBLE * kept / total, 6) AS kept_pct FROM k""",
)
def _(v):
    criteria = stations.StationCriteria(min_temperature_completeness_pct=30, min_years=4)
    return stations.selection_summary(v.stations(), criteria).withColumn("kept_pct", F.round("kept_pct", 6))


@query(
    "station_criteria",
    f"""WITH {STATIONS} SELECT station_id FROM stations WHERE temperature_completeness_pct >= 20 AND wind_speed_completeness_pct >= 40
        AND latitude BETWEEN 31 AND 34 AND longitude BETWEEN -99.5::DOUBLE AND -96 AND max_gap_duration_hours <= 300""",
)
def _(v):
    criteria = stations.StationCriteria(
        min_temperature_completeness_pct=20,
        min_wind_speed_completeness_pct=40,
        latitude=(31, 34),
        longitude=(-99.5, -96),
        max_gap_hours=300,
    )
    return stations.select_stations(v.stations(), criteria).select("station_id")


@query(
    "best_stations",
    f"""WITH {STATIONS} SELECT station_id, temperature_completeness_pct FROM stations
        WHERE temperature_completeness_pct >= 80 AND n_years >= 5 AND {VALID_COORDINATES} AND country_code = 'US'
        ORDER BY temperature_completeness_pct DESC, station_id LIMIT 10""",
)
def _(v):
    checked = stations.check_coordinates(v.stations())
    return stations.best_stations(checked, min_years=5).select("station_id", "temperature_completeness_pct")


_HIST = """SELECT least(floor((x - lo) / ((hi - lo) / {n})), {n} - 1)::BIGINT AS bin,
  round(lo + least(floor((x - lo) / ((hi - lo) / {n})), {n} - 1) * ((hi - lo) / {n}), 6) AS bin_start, count(*) AS n
  FROM src, (SELECT min(x) AS lo, max(x) AS hi FROM src) GROUP BY 1, 2"""


@query(
    "completeness_histogram",
    f"WITH {STATIONS}, src AS (SELECT temperature_completeness_pct AS x FROM stations), h AS ({_HIST.format(n=30)}) SELECT * FROM h",
)
def _(v):
    table = metadata.histogram(v.stations(), "temperature_completeness_pct", 30)
    return table.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "observation_histogram",
    f"WITH {STATIONS}, src AS (SELECT total_observation_count::DOUBLE AS x FROM stations), h AS ({_HIST.format(n=30)}) SELECT * FROM h",
)
def _(v):
    table = metadata.histogram(v.stations(), "total_observation_count", 30)
    return table.withColumn("bin_start", F.round("bin_start", 6))


@query(
    "cluster_statistics",
    f"""WITH {STATIONS} SELECT CAST(station_id % 5 AS INTEGER) AS cluster, count(*) AS station_count,
          round(avg(temperature_completeness_pct), 6) AS avg_temp_completeness, round(avg(total_observation_count), 6) AS avg_observations,
          round(avg(latitude), 6) AS centroid_lat, round(avg(longitude), 6) AS centroid_lon FROM stations WHERE station_id % 6 <> 5 GROUP BY 1""",
)
def _(v):
    label = F.when(F.col("station_id") % 6 != 5, (F.col("station_id") % 5).cast("int"))
    stats = metadata.cluster_stats(v.stations().withColumn("cluster", label))
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_temp_completeness", "avg_observations", "centroid_lat", "centroid_lon")})


@query("cluster_stations")
def _(v):
    features = ("latitude", "longitude", "temperature_completeness_pct", "total_observation_count")
    return cluster.cluster_stations(v.stations(), features).select("station_id", "cluster")


@query(
    "attach_cluster_label",
    f"""WITH {STATIONS} SELECT s.station_id, l.cluster FROM stations s
        LEFT JOIN (SELECT o_custkey AS station_id, CAST(count(*) % 5 AS INTEGER) AS cluster FROM orders GROUP BY 1) l USING (station_id)""",
)
def _(v):
    labels = v.table("orders").groupBy(F.col("o_custkey").alias("station_id")).agg((F.count("*") % 5).cast("int").alias("cluster"))
    return stations.attach_label(v.stations().select("station_id"), labels)


@query(
    "union_by_name",
    f"""WITH {STATIONS} SELECT station_id, elevation, NULL::DOUBLE AS n FROM stations WHERE station_id % 2 = 0
        UNION ALL SELECT station_id, NULL, total_observation_count::DOUBLE FROM stations WHERE station_id % 2 = 1""",
)
def _(v):
    table = v.stations()
    left = table.where(F.col("station_id") % 2 == 0).select("station_id", "elevation")
    right = table.where(F.col("station_id") % 2 == 1).select(F.col("total_observation_count").cast("double").alias("n"), "station_id")
    return stations.union_tables(left, right)


@query(
    "distinct_names",
    f"WITH {STATIONS} SELECT count(DISTINCT station_name) AS n_names, count(DISTINCT station_id) AS n_ids, count(DISTINCT country_code) AS n_countries FROM stations",
)
def _(v):
    return stations.distinct_counts(v.stations(), {"station_name": "n_names", "station_id": "n_ids", "country_code": "n_countries"})


# --- splits -------------------------------------------------------------------

_SHUFFLED = "ids AS (SELECT station_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', station_id)), station_id) AS p, count(*) OVER () AS n FROM stations)"


@query(
    "spatial_split",
    f"""WITH {STATIONS}, {_SHUFFLED} SELECT station_id, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train'
          WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM ids""",
)
def _(v):
    return splits.create_split("spatial", v.stations())


@query(
    "hybrid_split",
    f"""WITH {STATIONS}, {_SHUFFLED}, h AS (SELECT station_id, p - floor(n * 0.15::DOUBLE * 0.5::DOUBLE) AS q, n - floor(n * 0.15::DOUBLE * 0.5::DOUBLE) AS m FROM ids)
        SELECT station_id, CASE WHEN q <= 0 THEN 'test' WHEN q <= floor(m * (0.7::DOUBLE / 0.925::DOUBLE)) THEN 'train'
          WHEN q <= floor(m * (0.7::DOUBLE / 0.925::DOUBLE)) + floor(m * (0.15::DOUBLE / 0.925::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM h""",
)
def _(v):
    return splits.create_split("hybrid", v.stations())


_ALL = f"WITH {STATIONS} SELECT station_id, split FROM stations CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)"


@query("temporal_split_stations", _ALL)
def _(v):
    return splits.create_split("temporal", v.stations())


@query("simulated_split", _ALL)
def _(v):
    return splits.create_split("simulated", v.stations())


# --- files --------------------------------------------------------------------


@query("file_totals", f"WITH {FILES} SELECT year, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM listing GROUP BY 1")
def _(v):
    return manifest.file_totals(v.listing())


_COMPARED = """compared AS (SELECT coalesce(m.station_id, l.station_id) AS station_id, coalesce(m.year, l.year) AS year, m.size AS expected_size, l.size AS actual_size,
  CASE WHEN m.size IS NULL THEN 'unexpected' WHEN l.size IS NULL THEN 'missing' WHEN m.size > 0 AND m.size <> l.size THEN 'size_mismatch' ELSE 'found' END AS status
  FROM manifest m FULL OUTER JOIN listing l ON m.station_id = l.station_id AND m.year = l.year)"""


@query("compare_files", f"WITH {FILES}, {_COMPARED} SELECT station_id, year, status, coalesce(expected_size, -1) AS expected_size, coalesce(actual_size, -1) AS actual_size FROM compared")
def _(v):
    return manifest.compare_files(v.manifest(), v.listing()).fillna(-1, ["expected_size", "actual_size"])


@query("manifest_audit", f"WITH {FILES}, {_COMPARED} SELECT year, status, count(*) AS n_files FROM compared GROUP BY 1, 2")
def _(v):
    return manifest.audit(v.manifest(), v.listing())


_CODE = "(CASE ((station_id % 4) + 4) % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'MX' ELSE 'FR' END || CAST(station_id AS VARCHAR))"


@query(
    "clean_candidates",
    f"""WITH {FILES}, {_COMPARED} SELECT {_CODE} AS station_id, year,
          CASE WHEN ((station_id % 4) + 4) % 4 = 3 THEN 'filtered' ELSE 'corrupted' END AS reason, actual_size AS n_bytes, coalesce(expected_size, -1) AS expected_size
        FROM compared WHERE actual_size IS NOT NULL AND (((station_id % 4) + 4) % 4 = 3 OR status = 'size_mismatch')""",
)
def _(v):
    place = F.pmod(F.col("station_id"), F.lit(4))
    country = F.when(place == 0, "US").when(place == 1, "CA").when(place == 2, "MX").otherwise("FR")
    coded = lambda df: df.withColumn("station_id", F.concat(country, F.col("station_id").cast("string")))
    return manifest.clean_candidates(coded(v.manifest()), coded(v.listing())).fillna(-1, ["expected_size"])


@query(
    "country_report",
    f"""WITH {STATIONS}, counts AS (SELECT left(code, 2) AS country_code, count(*) AS n_stations, left(code, 2) IN ('US','CA','MX','RQ','VQ') AS north_america
          FROM (SELECT code FROM stations UNION ALL SELECT upper(left(c_mktsegment, 2)) || 'X' FROM customer) GROUP BY 1)
        SELECT * FROM counts WHERE north_america
        UNION ALL (SELECT * FROM counts WHERE NOT north_america ORDER BY n_stations DESC, country_code LIMIT 3)""",
)
def _(v):
    others = v.table("customer").select(F.concat(F.upper(F.substring("c_mktsegment", 1, 2)), F.lit("X")).alias("code"))
    ids = v.stations().select("code").unionByName(others)
    return inventory.country_report(ids, top=3, id_column="code")
