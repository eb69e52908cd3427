"""The given tables in the shapes the operators take, once as DataFrames and once as SQL.

* panel: weekly series per supplier with natural gaps, from the first week in lineitem to the last;
* obs: raw reports with types and codes (from events);
* stations: a station table with duplicates and bad values (from customer, orders);
* inventory: an official list to enrich it from (from customer, nation);
* listing and manifest: files found and files expected (from orders).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..session import tune
from ..sources.inventory import tidy_inventory

VARIABLES = ("quantity", "extendedprice", "discount", "tax")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def _week(day):
        return F.floor(F.datediff(day.cast("date"), F.lit("1995-01-02").cast("date")) / 7.0).cast("int")

    def cells(self) -> DataFrame:
        """Observed weekly means, one row per supplier and week."""
        return (
            self.table("lineitem")
            .groupBy(F.col("l_suppkey").alias("station_id"), self._week(F.col("l_shipdate")).alias("t"))
            .agg(
                F.round(F.avg("l_quantity"), 6).alias("quantity"),
                F.round(F.avg("l_extendedprice"), 6).alias("extendedprice"),
                F.round(F.avg("l_discount"), 8).alias("discount"),
                F.round(F.avg("l_tax"), 8).alias("tax"),
            )
        )

    def samples(self) -> DataFrame:
        """Every series covers the weeks that lineitem covers."""
        lines = self.table("lineitem")
        ids = lines.select(F.col("l_suppkey").alias("station_id")).distinct()
        first, last = self._week(F.min("l_shipdate")), self._week(F.max("l_shipdate"))
        span = lines.agg(F.struct(first.alias("first_t"), (last - first + 1).cast("bigint").alias("n_steps"))).scalar()
        return ids.select("station_id", span["first_t"].alias("first_t"), span["n_steps"].alias("n_steps"))

    def grid(self) -> DataFrame:
        """A row per series and week, a column per variable."""
        ts = F.timestamp_add("DAY", F.col("t") * 7, F.lit("1995-01-02").cast("timestamp_ntz"))
        wide = series.wide_grid(self.cells(), VARIABLES, stations=self.samples())
        return wide.select("station_id", "t", ts.cast("timestamp_ntz").alias("ts"), *VARIABLES)

    def panel(self) -> DataFrame:
        return series.unfold(self.grid(), VARIABLES, ["station_id", "t", "ts"])

    def panel_cells(self) -> DataFrame:
        """The keys of the panel's rows. No value is worked out: Spark leaves the observed cells out of the plan."""
        names = F.explode(F.array(*[F.lit(v) for v in VARIABLES])).alias("variable")
        return self.grid().select("station_id", "t").select("station_id", "t", names)

    def obs(self) -> DataFrame:
        return self.obs_from(self.table("events"))

    @staticmethod
    def obs_from(events: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.col("event_type")
        report = (
            F.when(kind == "view", "FM-15").when(kind == "click", "AUTO").when(kind == "purchase", "FM-12").when(kind == "signup", "FM12-SYNOP")
        )
        return events.select(
            F.col("user_id").alias("station_id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            report.alias("report_type"),
            F.when(k % 11 != 0, F.col("value")).alias("temperature"),
            (k % 10).cast("string").alias("temperature_quality_code"),
            F.round((F.col("value") * 7.3) % 360.0, 6).alias("wind_direction"),
            F.col("event_type").alias("source"),
            *more,
        )

    def located_obs(self) -> DataFrame:
        """The reports with name and coordinates, which change with time and are missing here and there."""
        k = F.get_json_object("props", "$.k").cast("int")
        user, at = F.col("user_id"), F.col("ts").cast("timestamp_ntz")
        place = {
            "station_name": F.when(k % 2 == 0, F.concat(F.lit("Site "), user.cast("string"), F.lit("/"), F.month(at).cast("string"))),
            "latitude": F.when(k % 7 != 0, F.round(30.0 + (user % 50) / 10.0 + F.month(at) / 100.0, 4)),
            "longitude": F.when(k % 5 != 0, F.round(-100.0 - F.dayofmonth(at) / 100.0, 4)),
            "elevation": F.when(k % 3 != 0, (user % 700 + F.hour(at)).cast("double")),
        }
        return self.obs_from(self.table("events").withColumns(place), tuple(place))

    def stations(self) -> DataFrame:
        key = F.col("c_custkey")
        ordered = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.count("*").alias("total_observation_count"),
                F.min("o_orderdate").cast("timestamp_ntz").alias("first_observation"),
                F.max("o_orderdate").cast("timestamp_ntz").alias("last_observation"),
                F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("years_available"),
            )
        )
        located = key % 97 != 0
        country = F.when(key % 4 == 0, "US").when(key % 4 == 1, "CA").when(key % 4 == 2, "MX").otherwise("FR")
        name = (
            F.when(key % 3 == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit("   NORTH-west ")))
            .when(key % 3 == 1, F.concat(F.lit("Station "), key.cast("string")))
            .otherwise(F.concat(F.col("c_name"), F.lit("  o'hare field")))
        )
        return (
            self.table("customer")
            .join(ordered, "c_custkey", "left")
            .select(
                key.alias("station_id"),
                country.alias("country_code"),
                F.concat(country, F.lpad(key.cast("string"), 9, "0")).alias("code"),
                name.alias("station_name"),
                F.when(located, 30.0 + ((key * 37) % 500) / 100.0).alias("latitude"),
                F.when(located, -100.0 + ((key * 91) % 500) / 100.0).alias("longitude"),
                F.col("c_acctbal").alias("elevation"),
                F.coalesce("total_observation_count", F.lit(0)).alias("total_observation_count"),
                "first_observation",
                "last_observation",
                F.coalesce("years_available", F.array().cast("array<int>")).alias("years_available"),
                ((key * 37) % 101).cast("double").alias("temperature_completeness_pct"),
                ((key * 53) % 101).cast("double").alias("wind_speed_completeness_pct"),
                ((key * 13) % 400).cast("double").alias("max_gap_duration_hours"),
            )
        )

    def raw_inventory(self) -> DataFrame:
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .where(key % 3 != 0)
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                key.alias("GHCN_ID"),
                (30.5 + ((key * 37) % 500) / 100.0).alias("LATITUDE"),
                (-99.5 + ((key * 91) % 500) / 100.0).alias("LONGITUDE"),
                (F.col("c_acctbal") / 2.0).alias("ELEVATION"),
                F.col("n_name").alias("STATE"),
                F.col("c_name").alias("NAME"),
                F.when(key % 5 == 0, "NA").otherwise(F.lpad(key.cast("string"), 5, "0")).alias("WMO_ID"),
                F.concat(F.lit("K"), key.cast("string"), F.lit("\r")).alias("ICAO"),
            )
        )

    def inventory(self) -> DataFrame:
        return tidy_inventory(self.raw_inventory())

    def manifest(self) -> DataFrame:
        """Files that should exist: one per customer and order year."""
        year = F.year("o_orderdate")
        return (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("station_id"), year.alias("year"))
            .agg((F.count("*") * 100).alias("size"))
        )

    def listing(self) -> DataFrame:
        """Files that do: some missing, some cut short, some unexpected."""
        mark = F.col("station_id") + F.col("year")
        kept = self.manifest().where(mark % 7 != 0)
        found = kept.select("station_id", "year", F.when(mark % 11 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
        extra = self.table("supplier").select(
            (-F.col("s_suppkey") - 1).alias("station_id"), F.lit(1995).alias("year"), F.lit(7).cast("bigint").alias("size")
        )
        return found.unionByName(extra)


CELLS = """cells AS MATERIALIZED (
  SELECT l_suppkey AS station_id,
         CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0::DOUBLE) AS INTEGER) AS t,
         round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 6) AS extendedprice,
         round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax
  FROM lineitem GROUP BY 1, 2),
span AS MATERIALIZED (SELECT min(t) AS lo, max(t) AS hi, CAST(max(t) - min(t) + 1 AS BIGINT) AS n FROM cells)"""

PANEL = (
    CELLS
    + """,
panel AS MATERIALIZED (
  SELECT g.station_id, g.t, TIMESTAMP '1995-01-02' + to_days(7 * g.t) AS ts, v.variable,
         CASE v.variable WHEN 'quantity' THEN c.quantity WHEN 'extendedprice' THEN c.extendedprice
                         WHEN 'discount' THEN c.discount ELSE c.tax END AS value
  FROM (SELECT s.station_id, CAST(r.t AS INTEGER) AS t
        FROM (SELECT DISTINCT station_id FROM cells) s, (SELECT unnest(generate_series(lo, hi)) AS t FROM span) r) g
  CROSS JOIN (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) v(variable)
  LEFT JOIN cells c ON c.station_id = g.station_id AND c.t = g.t)"""
)

OBS = """obs AS (
  SELECT user_id AS station_id, ts,
         CASE event_type WHEN 'view' THEN 'FM-15' WHEN 'click' THEN 'AUTO' WHEN 'purchase' THEN 'FM-12'
                         WHEN 'signup' THEN 'FM12-SYNOP' END AS report_type,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 11 <> 0 THEN value END AS temperature,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS VARCHAR) AS temperature_quality_code,
         round((value * 7.3::DOUBLE) % 360.0::DOUBLE, 6) AS wind_direction, event_type AS source
  FROM events)"""

_COUNTRY = "CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'MX' ELSE 'FR' END"

STATIONS = f"""stations AS (
  SELECT c.c_custkey AS station_id, {_COUNTRY} AS country_code,
         {_COUNTRY} || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0') AS code,
         CASE c.c_custkey % 3 WHEN 0 THEN '  ' || upper(c.c_name) || '   NORTH-west '
                              WHEN 1 THEN 'Station ' || CAST(c.c_custkey AS VARCHAR)
                              ELSE c.c_name || '  o''hare field' END AS station_name,
         CASE WHEN c.c_custkey % 97 <> 0 THEN 30.0::DOUBLE + ((c.c_custkey * 37) % 500)::DOUBLE / 100.0::DOUBLE END AS latitude,
         CASE WHEN c.c_custkey % 97 <> 0 THEN -100.0::DOUBLE + ((c.c_custkey * 91) % 500)::DOUBLE / 100.0::DOUBLE END AS longitude,
         c.c_acctbal AS elevation, coalesce(o.n, 0) AS total_observation_count,
         o.first_observation, o.last_observation, coalesce(o.n_years, 0) AS n_years,
         ((c.c_custkey * 37) % 101)::DOUBLE AS temperature_completeness_pct,
         ((c.c_custkey * 53) % 101)::DOUBLE AS wind_speed_completeness_pct,
         ((c.c_custkey * 13) % 400)::DOUBLE AS max_gap_duration_hours
  FROM customer c LEFT JOIN (
    SELECT o_custkey, count(*) AS n, min(o_orderdate) AS first_observation, max(o_orderdate) AS last_observation,
           count(DISTINCT year(o_orderdate)) AS n_years
    FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey)"""

INVENTORY = """inventory AS (
  SELECT c_custkey AS station_id, 30.5::DOUBLE + ((c_custkey * 37) % 500)::DOUBLE / 100.0::DOUBLE AS latitude,
         -99.5::DOUBLE + ((c_custkey * 91) % 500)::DOUBLE / 100.0::DOUBLE AS longitude,
         c_acctbal / 2.0::DOUBLE AS elevation, n_name AS state, c_name AS station_name,
         CASE WHEN c_custkey % 5 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') END AS wmo_id,
         'K' || CAST(c_custkey AS VARCHAR) AS icao_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0)"""

FILES = """manifest AS (
  SELECT o_custkey AS station_id, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) * 100 AS size FROM orders GROUP BY 1, 2),
listing AS (
  SELECT station_id, year, CASE WHEN (station_id + year) % 11 = 0 THEN size - 1 ELSE size END AS size
  FROM manifest WHERE (station_id + year) % 7 <> 0
  UNION ALL SELECT -s_suppkey - 1, 1995, 7 FROM supplier)"""
