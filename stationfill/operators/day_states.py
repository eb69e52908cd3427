"""Mergeable states of reports: all that the station table needs, one row per station and day.

A state is made in one grouping, combined before its only shuffle of instants. States of any
parts of the reports (files, say) merge into states of the whole, so a part that changes is
computed again alone. From states to stations there is one more shuffle, of days by station:
steps between days, years and types all follow from it.

A station has no more days than the calendar; a day's state holds the instants of its hourly
reports. Reports without a time are counted by type, in a state without a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import reports as R

#: The moments that each variable's statistics show.
STATS = {
    "temperature": ("min", "max", "mean", "std"),
    "dew_point_temperature": ("mean", "std"),
    "sea_level_pressure": ("min", "max", "mean", "std"),
}
LOCATION = {
    "station_name": T.StringType(),
    "latitude": T.DoubleType(),
    "longitude": T.DoubleType(),
    "elevation": T.DoubleType(),
}
_TYPES = "array<struct<report_type:string,n:bigint>>"


def valid(df: DataFrame, variable: str) -> Column:
    """Value present and, where the table has a quality code, code missing or valid."""
    rule = F.col(variable).isNotNull()
    code = next((n for n in df.columns if n.lower() == f"{variable}_quality_code"), None)
    return rule if code is None else rule & R.valid_code(F.col(code), df.schema[code].dataType)


def instants_of(micros: Column) -> Column:
    """Aggregate: the distinct instants, in order."""
    return F.array_sort(F.array_distinct(F.collect_list(micros)))


def steps(instants: Column) -> Column:
    """Whole seconds between consecutive instants, given in microseconds."""
    n = F.size(instants)
    later, earlier = F.slice(instants, 2, F.greatest(n - 1, F.lit(0))), F.slice(instants, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(later, earlier, lambda b, a: F.floor((b - a) / F.lit(1_000_000)))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def counted(labels: Column) -> Column:
    """Distinct labels of an array with their counts."""
    return F.transform(
        F.array_distinct(labels),
        lambda kind: F.struct(kind.alias("report_type"), F.size(F.filter(labels, lambda x: x == kind)).cast("bigint").alias("n")),
    )


def merged_counts(counts: Column) -> Column:
    """Counts by label of an array of (report_type, n), each label once, in order."""
    label = lambda x: x["report_type"]
    return F.transform(
        F.array_sort(F.array_distinct(F.transform(counts, label))),
        lambda kind: F.struct(
            kind.alias("report_type"),
            total(F.transform(F.filter(counts, lambda x: x["report_type"] == kind), lambda x: x["n"])).alias("n"),
        ),
    )


def day_states(reports: DataFrame, hourly_only: bool = True, part: str | None = None) -> DataFrame:
    """One row per station, day and, with ``part``, value of that column (a file name, say)."""
    hourly = R.is_hourly_report(F.col("report_type")) if hourly_only else F.lit(True)
    present = {name.lower() for name in reports.columns}
    at = F.col("ts").cast("timestamp")
    dated = F.col("ts").isNotNull()
    kind = F.coalesce("report_type", F.lit("null"))
    parts = [] if part is None else [F.col(part).alias("part")]
    when = F.coalesce(F.col("ts").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    located = [
        (F.min(F.when(F.col(c).isNotNull(), F.struct(when.alias("t"), F.col(c).cast(t).alias("x")))) if c in present
         else F.lit(None).cast(T.StructType([T.StructField("t", T.TimestampNTZType()), T.StructField("x", t)]))).alias(c)
        for c, t in LOCATION.items()
    ]
    complete = [
        (F.count_if(hourly & valid(reports, v)) if v in present else F.lit(0).cast("bigint")).alias(f"valid_{v}") for v in C.ALL_VARIABLES
    ]

    def moments(v: str) -> Column:
        good = F.when(hourly & valid(reports, v), F.col(v).cast("double")) if v in present else F.lit(None).cast("double")
        return F.struct(
            F.count(good).alias("n"), F.avg(good).alias("mean"), (F.var_pop(good) * F.count(good)).alias("m2"), F.min(good).alias("min"), F.max(good).alias("max")
        ).alias(f"moments_{v}")

    years = F.col("year") if "year" in present else F.year("ts")
    grouped = reports.groupBy("station_id", *parts, F.to_date(at).alias("day"), F.when(~dated, kind).alias("undated_type")).agg(
        F.count("*").alias("n"),
        F.count_if(hourly).alias("n_hourly"),
        F.count_if(hourly & dated).alias("n_dated"),
        instants_of(F.when(hourly, F.unix_micros(at))).alias("instants"),
        F.collect_list(F.when(dated, kind)).alias("__kinds"),
        F.min(F.when(hourly, F.col("ts"))).alias("first"),
        F.max(F.when(hourly, F.col("ts"))).alias("last"),
        F.collect_set(years.cast("int")).alias("years"),
        *located,
        *complete,
        *[moments(v) for v in STATS],
    )
    alone = F.array(F.struct(F.col("undated_type").alias("report_type"), F.col("n")))
    types = F.when(F.col("undated_type").isNotNull(), alone).otherwise(counted(F.col("__kinds"))).cast(_TYPES)
    return grouped.withColumn("types", types).drop("__kinds", "undated_type")


def _merged_moments(v: str) -> Column:
    """Aggregate: moments of the whole from the parts' own, spreads around means added to spreads of means."""
    m = F.col(f"moments_{v}")
    n, sums = F.sum(m["n"]), F.sum(m["n"] * m["mean"])
    around = F.sum(m["m2"]) + F.sum(m["n"] * m["mean"] * m["mean"]) - F.try_divide(sums * sums, n)
    return F.struct(
        n.alias("n"), F.try_divide(sums, n).alias("mean"), F.greatest(around, F.lit(0.0)).alias("m2"), F.min(m["min"]).alias("min"), F.max(m["max"]).alias("max")
    ).alias(f"moments_{v}")


def _merged(*more: Column) -> list[Column]:
    """Aggregates that merge all parts of states but their instants."""
    return [
        *[F.sum(c).alias(c) for c in ("n", "n_hourly", "n_dated")],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("years"))).alias("years"),
        merged_counts(F.flatten(F.collect_list("types"))).alias("types"),
        *[F.min(c).alias(c) for c in LOCATION],
        *[F.sum(f"valid_{v}").alias(f"valid_{v}") for v in C.ALL_VARIABLES],
        *[_merged_moments(v) for v in STATS],
        *more,
    ]


def merge_parts(states: DataFrame) -> DataFrame:
    """States of several parts as states of the whole: days that several parts have become one."""
    instants = F.array_sort(F.array_distinct(F.flatten(F.collect_list("instants")))).alias("instants")
    return states.groupBy("station_id", "day").agg(*_merged(instants))


def station_totals(states: DataFrame) -> DataFrame:
    """One row per station: everything merged, counts by year and the gaps between instants.

    ``states`` has each day of a station once.
    """
    own = steps(F.col("instants"))
    days = states.withColumns(
        {
            "__lo": F.try_element_at("instants", F.lit(1)),
            "__hi": F.try_element_at("instants", F.lit(-1)),
            "__longest": F.coalesce(F.array_max(own), F.lit(0).cast("bigint")),
            "__sum": total(own),
        }
    ).drop("instants")
    by_day = Window.partitionBy("station_id").orderBy(F.col("day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    step = F.floor((F.col("__lo") - F.last("__hi", ignorenulls=True).over(by_day)) / F.lit(1_000_000))
    stepped = days.withColumn("__step", step)
    gaps = [
        F.count_if(F.col("__step") > 24 * 3600).alias("__long"),
        F.greatest(F.max("__longest"), F.coalesce(F.max("__step"), F.lit(0))).alias("__longest"),
        (F.sum("__sum") + F.coalesce(F.sum("__step"), F.lit(0))).alias("__sum"),
        F.min("__lo").alias("__lo"),
        F.max("__hi").alias("__hi"),
    ]
    # Both groupings find a station's rows together already.
    yearly = stepped.groupBy("station_id", F.year("day").alias("__year")).agg(*_merged(*gaps))
    shown = F.when(F.col("__year").isNotNull() & (F.col("n_hourly") > 0), F.struct(F.col("__year").alias("year"), F.col("n_hourly").alias("n")))
    again = [
        F.sum("__long").alias("__long"),
        F.max("__longest").alias("__longest"),
        F.sum("__sum").alias("__sum"),
        F.min("__lo").alias("__lo"),
        F.max("__hi").alias("__hi"),
    ]
    whole = yearly.groupBy("station_id").agg(*_merged(*again, F.map_from_entries(F.array_sort(F.collect_list(shown))).alias("year_counts")))
    hour = F.lit(3600.0)
    several = F.col("n_dated") >= 2
    zero_unless = lambda value, zero: F.when(several, value).otherwise(F.lit(zero))
    return whole.withColumns(
        {
            "gap_count_24h": zero_unless(F.col("__long"), 0),
            "max_gap_hours": zero_unless(F.col("__longest") / hour, 0.0),
            "avg_interval_hours": zero_unless(F.try_divide(F.col("__sum") / hour, F.col("n_dated") - 1), 0.0),
            "expected_observations": zero_unless(F.floor(F.floor((F.col("__hi") - F.col("__lo")) / F.lit(1_000_000)) / hour) + 1, 0),
        }
    ).drop("__long", "__longest", "__sum", "__lo", "__hi")
