"""Raw reports: filters, quality rules, completeness, coverage, gaps, directions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import circular as G
from ..functions import reports as R
from ..operators import day_states, metadata, reports
from ..plans import file_states, preprocess
from ..session import ensure_checkpoint_dir
from ..sources import archive_source
from ..sources import observations as O
from .registry import query
from .views import OBS

HOURLY = "(report_type IS NULL OR NOT regexp_matches(report_type, '^(FM-12|FM12-SYNOP|FM-13|FM-14|FM-18|SY-AE|SY-AU|SY-MT|SY-SA|AERO)'))"
VALID = "(temperature_quality_code IS NULL OR temperature_quality_code IN ('', '1', '5', 'A', 'C'))"
GOOD = f"(temperature IS NOT NULL AND {VALID})"


@query("select_variables", f"WITH {OBS} SELECT station_id, ts, report_type, temperature, temperature_quality_code, wind_direction FROM obs")
def _(v):
    return reports.select_variables(v.obs())


@query(
    "blank_erroneous_values",
    f"""WITH {OBS} SELECT station_id, ts, temperature_quality_code,
        CASE WHEN temperature_quality_code IN ('3', '7') THEN NULL ELSE temperature END AS temperature FROM obs""",
)
def _(v):
    return reports.blank_flagged_values(v.obs()).select("station_id", "ts", "temperature_quality_code", "temperature")


@query(
    "blank_suspect_values",
    f"""WITH {OBS} SELECT station_id, ts,
        CASE WHEN temperature_quality_code IN ('3', '7', '2', '6') THEN NULL ELSE temperature END AS temperature FROM obs""",
)
def _(v):
    return reports.blank_flagged_values(v.obs(), suspect=True).select("station_id", "ts", "temperature")


@query("keep_valid_quality", f"WITH {OBS} SELECT station_id, ts, temperature FROM obs WHERE {VALID}")
def _(v):
    return reports.keep_by_quality(v.obs(), "temperature_quality_code").select("station_id", "ts", "temperature")


@query(
    "keep_invalid_quality",
    f"""WITH {OBS} SELECT station_id, ts, temperature FROM obs
        WHERE temperature_quality_code IN ('3','7','L','o','F','I','M','N','R','S','W','X','Z')""",
)
def _(v):
    return reports.keep_by_quality(v.obs(), "temperature_quality_code", valid=False).select("station_id", "ts", "temperature")


@query(
    "keep_valid_integer_codes",
    f"""WITH {OBS}, coded AS (SELECT station_id, ts, TRY_CAST(temperature_quality_code AS INTEGER) AS code FROM obs)
        SELECT * FROM coded WHERE code IS NULL OR code IN (1, 5)""",
)
def _(v):
    coded = v.obs().select("station_id", "ts", F.col("temperature_quality_code").cast("int").alias("code"))
    return reports.keep_by_quality(coded, "code")


@query("keep_hourly_reports", f"WITH {OBS} SELECT station_id, ts, report_type FROM obs WHERE {HOURLY}")
def _(v):
    return reports.keep_hourly(v.obs()).select("station_id", "ts", "report_type")


@query("allowed_report_types", f"WITH {OBS} SELECT station_id, ts, report_type FROM obs WHERE report_type IN ('AUTO', 'FM-15')")
def _(v):
    return reports.keep_report_types(v.obs()).select("station_id", "ts", "report_type")


@query(
    "unify_timestamps",
    f"""WITH {OBS} SELECT station_id, CASE WHEN station_id % 3 = 2 THEN NULL
          WHEN station_id % 3 = 0 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS ts FROM obs""",
)
def _(v):
    """A third of the reports with a text date, a third with date parts only, a third with neither readable."""
    kind = F.col("station_id") % 3
    text = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.lit("not a date"))
    part = lambda f: F.when(kind == 1, f("ts"))
    raw = v.obs().select(
        "station_id",
        text.alias("date"),
        part(F.year).alias("year"),
        part(F.month).alias("month"),
        part(F.dayofmonth).alias("day"),
        part(F.hour).alias("hour"),
        part(F.minute).alias("minute"),
    )
    return reports.unify_timestamps(raw).select("station_id", "ts")


@query(
    "normalize_columns",
    f"""WITH {OBS} SELECT station_id, ts, CASE WHEN station_id % 2 = 0 THEN temperature END AS temperature,
          temperature_quality_code FROM obs""",
)
def _(v):
    """Text numbers (half of them unreadable) and struct codes, brought to one type."""
    raw = v.obs().select(
        "station_id",
        "ts",
        F.when(F.col("station_id") % 2 == 0, F.col("temperature").cast("string")).otherwise(F.lit("n/a")).alias("Temperature"),
        F.struct(
            F.lit("x").alias("member1"), F.col("temperature_quality_code").cast("int").alias("member0")
        ).alias("temperature_Quality_Code"),
    )
    return O.normalize(raw).select("station_id", "ts", "temperature", "temperature_quality_code")


@query("filter_years_and_stations", f"WITH {OBS} SELECT station_id, ts, temperature FROM obs WHERE year(ts) IN (2024) AND station_id IN (3, 7, 11)")
def _(v):
    years, ids = O.parse_years("2010, 2023:2025, x"), O.parse_stations("3, 7,11")
    rows = v.obs()
    rows = rows.where(O.in_years(years)).where(O.of_stations(rows, ids))
    return rows.select("station_id", "ts", "temperature")


@query(
    "report_type_counts",
    f"WITH {OBS} SELECT station_id, coalesce(report_type, 'null') AS report_type, count(*) AS n FROM obs GROUP BY 1, 2",
)
def _(v):
    return metadata.report_type_counts(v.obs())


@query(
    "completeness",
    f"WITH {OBS} SELECT station_id, round(100.0::DOUBLE * count(*) FILTER ({GOOD}) / count(*), 6) AS completeness_pct FROM obs GROUP BY 1",
)
def _(v):
    obs = v.obs()
    return obs.groupBy("station_id").agg(F.round(metadata.completeness_pct(obs, "temperature"), 6).alias("completeness_pct"))


_STATS = """SELECT station_id, '{v}' AS variable, count(*) AS n, count(*) FILTER ({g}) AS n_valid, count(*) FILTER ({v} IS NULL) AS n_null,
  round(100.0::DOUBLE * count(*) FILTER ({g}) / count(*), 6) AS completeness_pct, round(avg({v}) FILTER ({g}), 6) AS mean,
  round(stddev_samp({v}) FILTER ({g}), 6) AS std, min({v}) FILTER ({g}) AS min, max({v}) FILTER ({g}) AS max FROM obs GROUP BY 1"""


@query(
    "variable_stats",
    f"WITH {OBS} "
    + _STATS.format(v="temperature", g=GOOD)
    + " UNION ALL "
    + _STATS.format(v="wind_direction", g="wind_direction IS NOT NULL"),
)
def _(v):
    stats = metadata.variable_stats(v.obs(), ["temperature", "wind_direction"])
    return stats.withColumns({c: F.round(c, 6) for c in ("completeness_pct", "mean", "std")})


@query("year_counts", f"WITH {OBS} SELECT station_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM obs GROUP BY 1, 2")
def _(v):
    return metadata.year_counts(v.obs())


@query(
    "coverage",
    f"""WITH {OBS} SELECT station_id, count(*) AS total_records_all_types, count(*) FILTER (NOT {HOURLY}) AS records_excluded_by_filter,
          count(*) FILTER ({HOURLY}) AS total_observation_count, min(ts) FILTER ({HOURLY}) AS first_observation,
          max(ts) FILTER ({HOURLY}) AS last_observation, count(DISTINCT year(ts)) AS n_years FROM obs GROUP BY 1""",
)
def _(v):
    covered = metadata.coverage(v.obs())
    return covered.withColumn("n_years", F.size("years_available").cast("bigint")).drop("years_available")


def _hours(column):
    """Whole seconds over counts make exact ties at six places; a nudge on both engines keeps them off."""
    return F.when(F.col(column) > 0, F.round(F.col(column) + 1e-9, 6)).otherwise(F.col(column))


GAPS = """steps AS (SELECT station_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY station_id ORDER BY ts))) // 1000000 AS s FROM {src}),
gaps AS (SELECT station_id, CASE WHEN count(*) >= 2 THEN count(*) FILTER (s > 86400) ELSE 0 END AS gap_count_24h,
  CASE WHEN count(*) >= 2 THEN round(max(s) / 3600.0::DOUBLE + 1e-9::DOUBLE, 6) ELSE 0 END AS max_gap_hours,
  CASE WHEN count(*) >= 2 THEN round(avg(s) / 3600.0::DOUBLE + 1e-9::DOUBLE, 6) ELSE 0 END AS avg_interval_hours,
  count(*) AS total_observations,
  CASE WHEN count(*) >= 2 THEN CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 / 3600.0::DOUBLE) + 1 AS BIGINT) ELSE 0 END AS expected_observations
  FROM steps GROUP BY 1)"""


@query("gap_analysis", f"WITH {OBS}, {GAPS.format(src='obs')} SELECT * FROM gaps")
def _(v):
    gaps = metadata.gap_analysis(v.obs())
    return gaps.withColumns({c: _hours(c) for c in ("max_gap_hours", "avg_interval_hours")})


_META = f"""meta AS (SELECT o.station_id, left(CAST(o.station_id AS VARCHAR), 2) AS country_code, o.n AS total_records_all_types,
    o.n - o.h AS records_excluded_by_filter, o.h AS total_observation_count, o.first_observation, o.last_observation, o.n_years,
    o.temperature_completeness_pct, o.wind_direction_completeness_pct, o.visibility_completeness_pct, o.temperature_min, o.temperature_max,
    o.temperature_mean, o.temperature_std, t.types AS report_types,
    coalesce(y.years, '') AS years, coalesce(g.gap_count_24h, 0) AS gap_count_24h,
    g.max_gap_hours AS max_gap_duration_hours, g.avg_interval_hours AS avg_observation_interval_hours
  FROM (SELECT station_id, count(*) AS n, count(*) FILTER ({HOURLY}) AS h, min(ts) FILTER ({HOURLY}) AS first_observation,
          max(ts) FILTER ({HOURLY}) AS last_observation, count(DISTINCT year(ts)) AS n_years,
          coalesce(round(100.0::DOUBLE * count(*) FILTER ({HOURLY} AND {GOOD}) / nullif(count(*) FILTER ({HOURLY}), 0), 6), 0) AS temperature_completeness_pct,
          coalesce(round(100.0::DOUBLE * count(wind_direction) FILTER ({HOURLY}) / nullif(count(*) FILTER ({HOURLY}), 0), 6), 0) AS wind_direction_completeness_pct,
          0.0::DOUBLE AS visibility_completeness_pct,
          min(temperature) FILTER ({HOURLY} AND {GOOD}) AS temperature_min, max(temperature) FILTER ({HOURLY} AND {GOOD}) AS temperature_max,
          round(avg(temperature) FILTER ({HOURLY} AND {GOOD}), 6) AS temperature_mean,
          round(stddev_samp(temperature) FILTER ({HOURLY} AND {GOOD}), 6) AS temperature_std FROM obs GROUP BY 1) o
  JOIN (SELECT station_id, string_agg(report_type || ':' || n, ',' ORDER BY report_type) AS types
        FROM (SELECT station_id, coalesce(report_type, 'null') AS report_type, count(*) AS n FROM obs GROUP BY 1, 2) GROUP BY 1) t USING (station_id)
  LEFT JOIN (SELECT station_id, string_agg(y || ':' || n, ',' ORDER BY y) AS years
        FROM (SELECT station_id, year(ts) AS y, count(*) AS n FROM obs WHERE {HOURLY} GROUP BY 1, 2) GROUP BY 1) y USING (station_id)
  LEFT JOIN gaps g USING (station_id))"""

METADATA = f"{OBS}, hourly AS (SELECT * FROM obs WHERE {HOURLY}), {GAPS.format(src='hourly')}, {_META}"


def flat_metadata(table):
    """Scalars and texts of the station table, for comparison with SQL."""
    as_text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    rounded = {c: F.round(c, 6) for c in ("temperature_completeness_pct", "wind_direction_completeness_pct")}
    rounded |= {c: _hours(c) for c in ("max_gap_duration_hours", "avg_observation_interval_hours")}
    return table.withColumns(rounded).select(
        "station_id",
        "country_code",
        "total_records_all_types",
        "records_excluded_by_filter",
        "total_observation_count",
        "first_observation",
        "last_observation",
        F.size("years_available").cast("bigint").alias("n_years"),
        "temperature_completeness_pct",
        "wind_direction_completeness_pct",
        "visibility_completeness_pct",
        F.col("temperature_stats.min").alias("temperature_min"),
        F.col("temperature_stats.max").alias("temperature_max"),
        F.round("temperature_stats.mean", 6).alias("temperature_mean"),
        F.round("temperature_stats.std", 6).alias("temperature_std"),
        as_text("report_type_counts").alias("report_types"),
        as_text("year_counts").alias("years"),
        "gap_count_24h",
        "max_gap_duration_hours",
        "avg_observation_interval_hours",
    )


@query("station_metadata", f"WITH {METADATA} SELECT * FROM meta")
def _(v):
    return flat_metadata(metadata.station_metadata(v.obs()))


@query(
    "metadata_summary",
    f"""WITH {METADATA} SELECT count(*) AS total_stations, round(avg(total_observation_count), 6) AS avg_observations,
          sum(total_observation_count)::BIGINT AS total_observations, round(avg(temperature_completeness_pct), 4) AS avg_temperature_completeness,
          count(*) FILTER (temperature_completeness_pct > 90) AS stations_over_90_pct,
          count(*) FILTER (total_observation_count = 0) AS stations_without_hourly FROM meta""",
)
def _(v):
    summary = metadata.metadata_summary(metadata.station_metadata(v.obs()))
    return summary.withColumn("avg_observations", F.round("avg_observations", 6)).withColumn(
        "avg_temperature_completeness", F.round("avg_temperature_completeness", 4)
    )


@query(
    "metadata_by_source",
    f"""WITH {OBS.replace("user_id AS station_id", "event_type AS station_id")}, hourly AS (SELECT * FROM obs WHERE {HOURLY}),
        {GAPS.format(src='hourly')}, {_META} SELECT * FROM meta""",
)
def _(v):
    """Few stations with many reports each, two of them summaries only."""
    return flat_metadata(metadata.station_metadata(v.obs().withColumn("station_id", F.col("source"))))


@query("station_metadata_from_parts", f"WITH {METADATA} SELECT * FROM meta")
def _(v):
    """The same table from states of four parts of the reports, merged: days and instants are in several of them."""
    parts = day_states.day_states(v.obs(), part="source")
    return flat_metadata(metadata.metadata_of_states(day_states.merge_parts(parts)))


def archived(v):
    """The reports as an archive of files in the shared folder; gives its root."""
    ensure_checkpoint_dir(v.spark)
    root = f"{v.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archive-{uuid.uuid4().hex}"
    archive_source.write_archive(v.obs(), root).agg(F.sum("n")).first()
    return root


def _as_number(table):
    return table.withColumn("station_id", F.col("station_id").cast("bigint"))


@query("station_metadata_from_archive", f"WITH {METADATA} SELECT * FROM meta")
def _(v):
    """The same table from files, one per station and year, through the archive data source."""
    rows = archive_source.read_archive(v.spark, archived(v), variables=["temperature", "wind_direction"])
    return _as_number(flat_metadata(metadata.station_metadata(rows)))


@query("station_metadata_from_file_states", f"WITH {METADATA} SELECT * FROM meta")
def _(v):
    """The same table from states per file, added in two runs: the first knows half of the years only."""
    root = archived(v)
    years = sorted(r[0] for r in O.list_years(O.list_files(v.spark, root)).collect())
    states = f"{root}-states"
    file_states.add_states(v.spark, root, states, years[: len(years) // 2 + 1])
    return _as_number(flat_metadata(file_states.station_table(v.spark, root, states)))


@query(
    "reports_of_years_from_archive",
    f"""WITH {OBS} SELECT station_id, CAST(year(ts) AS INTEGER) AS year, count(*) AS n, count(temperature) AS n_temperature, round(sum(temperature) + 1e-7::DOUBLE, 4) AS total, min(ts) AS first
        FROM obs WHERE station_id % 3 = 0 AND year(ts) = (SELECT min(year(ts)) FROM obs) GROUP BY 1, 2""",
)
def _(v):
    """Files of a third of the stations in the first year, chosen by their names."""
    root = archived(v)
    listed = O.list_files(v.spark, root)
    year = listed.agg(F.min("year")).first()[0]
    ids = O.list_stations(listed).where(F.col("station_id").cast("bigint") % 3 == 0)
    rows = O.read_observations(v.spark, root, [year], ids)
    return _as_number(rows).groupBy("station_id", "year").agg(
        F.count("*").alias("n"), F.count("temperature").alias("n_temperature"), F.round(F.sum("temperature") + 1e-7, 4).alias("total"), F.min("ts").alias("first")
    )


@query(
    "archive_census",
    f"""WITH {OBS}, f AS (SELECT DISTINCT station_id, year(ts) AS year FROM obs), c AS (SELECT unnest(['STATION', 'DATE', 'temperature_Report_Type', 'temperature',
          'temperature_quality_code', 'wind_direction', 'source']) AS "column")
        SELECT "column", CASE "column" WHEN 'STATION' THEN 'int64' WHEN 'DATE' THEN 'timestamp[us]' WHEN 'temperature' THEN 'double' WHEN 'wind_direction' THEN 'double' ELSE 'string' END AS type,
          count(*) AS n_files, count(DISTINCT station_id) AS n_stations FROM f, c GROUP BY 1, 2""",
)
def _(v):
    """Columns and types of all files, from their footers."""
    report = archive_source.file_report(v.spark, archived(v)).where(F.col("error").isNull())
    return report.groupBy("column", "type").agg(F.count("*").alias("n_files"), F.count_distinct("station_id").alias("n_stations"))


@query(
    "station_locations",
    """WITH located AS (
         SELECT user_id AS station_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
       p AS (SELECT station_id, ts, CASE WHEN k % 2 = 0 THEN 'Site ' || user_id || '/' || month(ts) END AS station_name,
           CASE WHEN k % 7 <> 0 THEN round(30.0::DOUBLE + (user_id % 50) / 10.0::DOUBLE + month(ts) / 100.0::DOUBLE, 4) END AS latitude,
           CASE WHEN k % 5 <> 0 THEN round(-100.0::DOUBLE - day(ts) / 100.0::DOUBLE, 4) END AS longitude,
           CASE WHEN k % 3 <> 0 THEN (user_id % 700 + hour(ts))::DOUBLE END AS elevation FROM located)
       SELECT station_id, coalesce(arg_min(station_name, ts) FILTER (station_name IS NOT NULL), '') AS station_name,
         arg_min(latitude, ts) FILTER (latitude IS NOT NULL) AS latitude, arg_min(longitude, ts) FILTER (longitude IS NOT NULL) AS longitude,
         arg_min(elevation, ts) FILTER (elevation IS NOT NULL) AS elevation FROM p GROUP BY 1""",
)
def _(v):
    """Name and coordinates of a station are those of its earliest report that has them."""
    return metadata.station_metadata(v.located_obs()).select("station_id", "station_name", "latitude", "longitude", "elevation")


@query(
    "update_status",
    """WITH base AS (SELECT o_custkey AS station_id, max(o_orderdate) AS latest FROM orders GROUP BY 1)
       SELECT station_id, CASE WHEN station_id % 5 = 0 THEN 'new' WHEN station_id % 7 = 0 THEN 'changed'
         WHEN latest > TIMESTAMP '2000-06-01' THEN 'changed' ELSE 'unchanged' END AS status FROM base""",
)
def _(v):
    files = v.table("orders").select(F.col("o_custkey").alias("station_id"), F.col("o_orderdate").alias("modified_at"))
    known = files.select("station_id").distinct().where(F.col("station_id") % 5 != 0)
    at = F.when(F.col("station_id") % 7 != 0, F.lit("2000-06-01").cast("timestamp_ntz")).alias("metadata_computed_at")
    return metadata.update_status(files, files, known.select("station_id", at))


@query(
    "incremental_metadata",
    f"""WITH {METADATA} SELECT station_id, CASE WHEN station_id % 4 = 0 THEN -1 ELSE total_observation_count END AS total_observation_count FROM meta""",
)
def _(v):
    """A quarter of the stations are up to date and keep their stored row (count -1)."""
    obs = v.obs()
    stored = obs.select("station_id").distinct().where(F.col("station_id") % 4 == 0).select(
        "station_id", F.lit(-1).cast("bigint").alias("total_observation_count"), F.lit("2030-01-01").cast("timestamp_ntz").alias("metadata_computed_at")
    )
    files = obs.select("station_id", F.col("ts").alias("modified_at"))
    return metadata.update_metadata(obs, files, stored).select("station_id", "total_observation_count")


@query(
    "merge_metadata",
    f"""WITH {OBS}, ids AS (SELECT DISTINCT station_id FROM obs)
        SELECT station_id, 'old' AS origin, NULL AS note FROM ids WHERE station_id % 3 <> 0
        UNION ALL SELECT station_id, 'new', 'recomputed' FROM ids WHERE station_id % 3 = 0""",
)
def _(v):
    ids = v.obs().select("station_id").distinct()
    existing = ids.select("station_id", F.lit("old").alias("origin"))
    recomputed = ids.where(F.col("station_id") % 3 == 0).select("station_id", F.lit("new").alias("origin"), F.lit("recomputed").alias("note"))
    return metadata.merge_metadata(existing, recomputed)


@query(
    "circular_statistics",
    f"""WITH {OBS}, s AS (SELECT source, sum(sin(radians(wind_direction))) AS y, sum(cos(radians(wind_direction))) AS x, count(wind_direction) AS n
          FROM obs GROUP BY 1)
        SELECT source, round(((degrees(atan2(y, x)) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE, 5) AS mean_direction,
          round(sqrt(-2.0::DOUBLE * ln(least(greatest(sqrt(x * x + y * y) / n, 1e-7::DOUBLE), 1.0::DOUBLE))), 6) AS std_direction FROM s""",
)
def _(v):
    d = F.col("wind_direction")
    return v.obs().groupBy("source").agg(
        F.round(G.circular_mean(d), 5).alias("mean_direction"), F.round(G.circular_std(d), 6).alias("std_direction")
    )


@query(
    "direction_encoding",
    f"""WITH {OBS} SELECT station_id, ts, round(sin(radians(wind_direction)), 6) AS dir_sin, round(cos(radians(wind_direction)), 6) AS dir_cos,
          round(wind_direction % 360.0::DOUBLE, 4) AS decoded,
          round(((90.0::DOUBLE - wind_direction + 180.0::DOUBLE) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE, 6) AS turn_to_east
        FROM obs""",
)
def _(v):
    d = F.col("wind_direction")
    s, c = G.direction_sin(d), G.direction_cos(d)
    decoded = F.round(G.direction_from(s, c), 4)
    return v.obs().select(
        "station_id",
        "ts",
        F.round(s, 6).alias("dir_sin"),
        F.round(c, 6).alias("dir_cos"),
        F.when(decoded == 360.0, 0.0).otherwise(decoded).alias("decoded"),
        F.round(G.angular_difference(d, F.lit(90.0)), 6).alias("turn_to_east"),
    )


_FACTS = """ends AS (SELECT station_id, min(ts) AS lo, max(ts) AS hi FROM obs GROUP BY 1),
  rows AS (SELECT o.station_id, o.ts, CASE WHEN temperature_quality_code IN ('3', '7') THEN NULL ELSE temperature END AS temperature
           FROM obs o WHERE {hourly})"""


def _prepared(v, strategy: str):
    """Every station of the reports, with the range of its reports."""
    table = v.obs().groupBy("station_id").agg(F.min("ts").alias("first_observation"), F.max("ts").alias("last_observation"))
    for name in ("latitude", "longitude", "elevation"):
        table = table.withColumn(name, F.lit(None).cast("double"))
    done = preprocess.prepare(v.obs(), table, table, strategy, variables=("temperature",))
    return done.select("station_id", "ts", "temperature", "split")


@query(
    "prepare_temporal",
    f"""WITH {OBS}, {_FACTS.format(hourly=HOURLY)},
  placed AS (SELECT r.*, epoch(r.ts)::BIGINT - epoch(lo)::BIGINT AS p, epoch(hi)::BIGINT - epoch(lo)::BIGINT + 1 AS n
             FROM rows r JOIN ends e USING (station_id))
  SELECT station_id, ts, temperature, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN p < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM placed""",
)
def _(v):
    """Every row in exactly one split, by its place in its station's range."""
    return _prepared(v, "temporal")


@query("prepare_simulated", f"WITH {OBS}, {_FACTS.format(hourly=HOURLY)} SELECT station_id, ts, temperature, 'all' AS split FROM rows")
def _(v):
    """One copy of the rows; the splits are masks over them."""
    return _prepared(v, "simulated")


@query(
    "prepare_spatial",
    f"""WITH {OBS}, {_FACTS.format(hourly=HOURLY)},
  drawn AS (SELECT station_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', station_id)), station_id) AS position, count(*) OVER () AS n_ids FROM ends)
  SELECT r.station_id, r.ts, r.temperature, CASE WHEN position <= floor(n_ids * 0.7::DOUBLE) THEN 'train'
    WHEN position <= floor(n_ids * 0.7::DOUBLE) + floor(n_ids * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM rows r JOIN drawn USING (station_id)""",
)
def _(v):
    """Whole stations in one split each."""
    return _prepared(v, "spatial")
