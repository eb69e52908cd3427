"""What gap filling does to climate indices: degree days, heat waves and cold snaps.

Input: ``station_id, ts, truth, estimate``. Days are grouped first; everything
after works on one row per station and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import running_sum

SOURCES = ("truth", "estimate")


def daily_values(cells: DataFrame) -> DataFrame:
    """Mean, lowest and highest value per station, day and source; days without values are left out."""
    day = F.to_date("ts").alias("day")
    rules = {"mean": F.avg, "min": F.min, "max": F.max}
    wide = cells.groupBy("station_id", day).agg(
        *[F.struct(F.lit(s).alias("source"), *[rule(s).alias(name) for name, rule in rules.items()]).alias(s) for s in SOURCES]
    )
    return wide.select("station_id", "day", F.inline(F.array(*SOURCES))).where(F.col("mean").isNotNull())


def degree_days(
    cells: DataFrame, heating_base: float = 18.0, cooling_base: float = 18.0, growing_base: float = 10.0
) -> DataFrame:
    """Heating, cooling and growing degree days per station and year, of truth and estimate."""
    above = lambda base: F.sum(F.greatest(F.col("mean") - base, F.lit(0.0)))
    return (
        daily_values(cells)
        .groupBy("station_id", F.year("day").alias("year"), "source")
        .agg(
            F.sum(F.greatest(heating_base - F.col("mean"), F.lit(0.0))).alias("heating"),
            above(cooling_base).alias("cooling"),
            above(growing_base).alias("growing"),
            F.count("*").alias("n_days"),
        )
    )


def compare_sources(table: DataFrame, keys, measures) -> DataFrame:
    """Truth, estimate and their difference side by side."""
    pick = lambda m, s: F.max(F.when(F.col("source") == s, F.col(m)))
    wide = table.groupBy(*keys).agg(*[pick(m, s).alias(f"{m}_{s}") for m in measures for s in SOURCES])
    return wide.select("*", *[(F.col(f"{m}_estimate") - F.col(f"{m}_truth")).alias(f"{m}_diff") for m in measures])


def extreme_spells(
    cells: DataFrame, heat_threshold: float = 35.0, cold_threshold: float = -10.0, min_days: int = 3
) -> DataFrame:
    """Runs of at least ``min_days`` consecutive hot (daily high above) or cold (daily low below) days.

    A day number minus the count of such days so far is constant within a run.
    """
    kinds = F.array(
        F.when(F.col("max") > heat_threshold, F.lit("heat")), F.when(F.col("min") < cold_threshold, F.lit("cold"))
    )
    flagged = (
        daily_values(cells)
        .select("station_id", "source", F.explode(kinds).alias("kind"), F.datediff("day", F.lit("1970-01-01")).alias("t"))
        .where(F.col("kind").isNotNull())
    )
    numbered = running_sum(flagged, ["station_id", "source", "kind"], F.lit(1))
    runs = numbered.groupBy("station_id", "source", "kind", (F.col("t") - F.col("position")).alias("run")).agg(
        F.min("t").alias("start_day"), F.count("*").alias("n_days")
    )
    return runs.where(F.col("n_days") >= min_days).select(
        "station_id", "source", "kind", F.date_add(F.lit("1970-01-01").cast("date"), F.col("start_day")).alias("start"), "n_days"
    )


def spell_totals(spells: DataFrame) -> DataFrame:
    return spells.groupBy("station_id", "kind", "source").agg(
        F.count("*").alias("n_spells"), F.sum("n_days").alias("spell_days")
    )
