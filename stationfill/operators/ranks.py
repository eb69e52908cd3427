"""Ranks and exact quantiles over a whole table, without one global sort task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import digest
from ..session import checkpointed, fan_out


def shuffled_rank(ids: DataFrame, id_column: str, seed) -> DataFrame:
    """Distinct ids with ``position`` (1-based, in hash order) and ``n_ids``.

    The first four hex digits of the hash cut the ids into 65,536 even buckets;
    only bucket counts are summed in one place.
    """
    hashed = (
        ids.select(id_column)
        .distinct()
        .withColumn("__digest", digest(seed, F.col(id_column)))
        .withColumn("__bucket", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    )
    counts = hashed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    line = Window.partitionBy(F.lit(0))
    offsets = counts.select(
        "__bucket",
        (F.sum("__n").over(line.orderBy("__bucket")) - F.col("__n")).alias("__offset"),
        F.sum("__n").over(line).alias("n_ids"),
    )
    inside = Window.partitionBy("__bucket").orderBy("__digest", id_column)
    return hashed.join(F.broadcast(offsets), "__bucket").select(
        id_column, (F.col("__offset") + F.row_number().over(inside)).alias("position"), "n_ids"
    )


def _counted_in_order(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """Per key and distinct value: ``n`` rows, ``upto`` (rows at or below it) and ``measures``.

    Equal values are counted before the shuffle. The distinct values are range
    partitioned and that layout is checkpointed, so both readers see the same cuts;
    a key of any size is spread over partitions, and only counts are summed across them.
    """
    distinct = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in (measures or {}).items()]
    )
    ranged = checkpointed(
        distinct.repartitionByRange(fan_out(df.sparkSession), *keys, value).withColumn("__part", F.spark_partition_id())
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "__part")
        .agg(F.sum("n").alias("__n"))
        .select(
            *[F.col(k).alias(f"__{k}") for k in keys],
            F.col("__part").alias("__at"),
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"),
        )
    )
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    upto = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, same)
        .withColumn("upto", F.col("__offset") + F.sum("n").over(upto))
        .drop("__part", "__at", "__offset", *[f"__{k}" for k in keys])
    )


def tie_averaged_ranks(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """Per key and distinct value: ``n`` rows, their mean rank, and ``measures``."""
    counted = _counted_in_order(df, keys, value, measures)
    return counted.withColumn("mean_rank", F.col("upto") - (F.col("n") - 1) / 2.0).drop("upto")


@F.pandas_udf(T.LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """The bits of doubles as numbers that order as the doubles do."""
    numbers = values.to_numpy(np.float64) + 0.0  # -0.0 becomes 0.0
    bits = np.where(np.isnan(numbers), np.nan, numbers).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


#: Bits that one level of the selection looks at, and levels to see all of a double.
_DIGIT, _LEVELS = 16, 4


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], by: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles ``q0``, ``q1``, … of the non-NULL values, one row (per ``by``).

    Radix selection: values are counted by their first 16 bits in order, the digit that holds each
    wanted rank is kept, values with that digit are counted by their next 16 bits, and so on. A level
    shuffles one row per digit and rank, whatever the values; all groups go together, and no job
    runs while the plan is made. A NULL group is a group. Without values there is no row per group,
    and one row of NULLs without ``by``. NaN comes after all numbers.
    """
    group = F.col(by) if by else F.lit(0)
    bits = _ordered_bits(F.col(value).cast("double"))
    present = df.where(F.col(value).isNotNull()).select(group.alias("__g"), F.col(value).cast("double").alias("v"), bits.alias("__bits"))

    def digit(level: int) -> Column:
        shifted = F.shiftright("__bits", 64 - _DIGIT * level)
        # The first digit keeps its sign, so that negative numbers come first.
        return (shifted if level == 1 else shifted.bitwiseAND(F.lit((1 << _DIGIT) - 1))).alias("__digit")

    def prefix(level: int) -> Column:
        return F.shiftright("__bits", 64 - _DIGIT * level)

    # The wanted ranks ride along with the digits: every level reads the values and the level before once.
    heads = None
    for level in range(1, _LEVELS + 1):
        if level == 1:
            counted = present.groupBy("__g", digit(1)).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
            parts = Window.partitionBy("__g")
            placed = counted.withColumns({"__total": F.sum("n").over(parts), "__prefix": F.col("__digit")})
            last = F.col("__total") - 1
            ends = []
            for i, p in enumerate(probabilities):
                low = F.floor(last * float(p))
                ends += [F.struct(F.lit(2 * i).alias("i"), low.alias("rank")), F.struct(F.lit(2 * i + 1).alias("i"), F.least(low + 1, last).alias("rank"))]
            placed = placed.withColumn("__ranks", F.array(*ends))
        else:
            same = F.col("__g").eqNullSafe(F.col("__h")) & (prefix(level - 1) == F.col("__p"))
            chosen = heads.select(F.col("__g").alias("__h"), F.col("__prefix").alias("__p"), "__ranks", "__total")
            counted = present.join(chosen, same).groupBy("__g", "__p", digit(level)).agg(
                F.count(F.lit(1)).alias("n"), F.min("v").alias("v"), F.any_value("__ranks").alias("__ranks"), F.any_value("__total").alias("__total")
            )
            parts = Window.partitionBy("__g", "__p")
            placed = counted.withColumn("__prefix", F.shiftleft("__p", _DIGIT) + F.col("__digit"))
        upto = F.sum("n").over(parts.orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("__upto") - F.col("n")
        here = F.filter("__ranks", lambda r: (r["rank"] >= F.col("__before")) & (r["rank"] < F.col("__upto")))
        inside = F.transform(here, lambda r: F.struct(r["i"].alias("i"), (r["rank"] - F.col("__before")).alias("rank")))
        heads = (
            placed.withColumn("__upto", upto)
            .withColumn("__before", before)
            .select("__g", "__prefix", "__total", "v", inside.alias("__ranks"))
            .where(F.size("__ranks") > 0)
        )
    wanted = heads.select("__g", "__total", "v", F.explode("__ranks.i").alias("i"))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    quantiles = []
    for i, p in enumerate(probabilities):
        spot = (F.max("__total") - 1) * float(p)
        part = spot - F.floor(spot)
        # On a rank the value itself, whatever follows it.
        between = at(2 * i) + (at(2 * i + 1) - at(2 * i)) * part
        quantiles.append(F.when(part == 0, at(2 * i)).otherwise(between).alias(f"q{i}"))
    if by:
        return wanted.groupBy(F.col("__g").alias(by)).agg(*quantiles)
    return wanted.agg(*quantiles)


def quantile_values(df: DataFrame, value: str, probabilities: list[float]) -> list[Column]:
    """The same over the whole column, as literals: nothing has to be joined to use them. This runs a job."""
    return [F.lit(x).cast("double") for x in exact_quantiles(df, value, probabilities).first()]
