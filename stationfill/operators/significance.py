"""Paired comparisons of two methods' errors, one row per comparison.

``keys`` names the comparison (for example two method labels and a variable).
Statistics are grouped aggregates; everything else is built-in functions of the aggregated rows.
Undefined numbers are NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import DRAW_RANGE
from .ranks import tie_averaged_ranks


# Below this the series of the error function is summed, above it the continued fraction of its complement.
_TURN, _TERMS = 2.5, 80


def normal_tail(z: str | Column) -> Column:
    """Two-sided tail of the standard normal, from built-in functions."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / math.sqrt(2.0)
    # erf = 2/sqrt(pi) exp(-x^2) (x + 2x^3/3 + 4x^5/15 + ...), all terms positive
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda s, n: F.struct(
            (s["term"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("term"),
            (s["total"] + s["term"] * 2.0 * x * x / (2.0 * n + 1.0)).alias("total"),
        ),
        lambda s: s["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n / 2.0 / (x + f), lambda f: 1.0 / (x + f)
    )
    scale = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < _TURN, 1.0 - 2.0 * scale * series).when(x.isNotNull(), scale * fraction)


def _pairs(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("err_a").isNotNull() & F.col("err_b").isNotNull())


def _verdict(difference: Column, alpha: float) -> list[Column]:
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    text = (
        F.when(F.col("statistic").isNull(), "undecided: too few pairs, or all alike")
        .when(significant, F.when(difference < 0, "A has the smaller errors").otherwise("B has the smaller errors"))
        .otherwise("no difference shown")
    )
    return [significant.alias("significant"), text.alias("interpretation")]


def paired_t_test(errors: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """t of the mean difference; its p-value is given for more than 30 pairs."""
    d = F.col("err_a") - F.col("err_b")
    sums = _pairs(errors).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))
    usable = (F.col("n") >= 2) & (F.col("std_diff") > 0)
    stats = sums.withColumn("statistic", F.when(usable, F.col("mean_diff") / (F.col("std_diff") / F.sqrt("n"))))
    stats = stats.withColumn("effect_size", F.when(usable, F.col("mean_diff") / F.col("std_diff")))
    tail = F.when(~usable | F.col("std_diff").isNull(), 1.0).when(F.col("n") > 30, normal_tail("statistic"))
    return stats.withColumn("p_value", tail).select(
        *keys,
        F.lit("paired_t_test").alias("test_name"),
        "n",
        "mean_diff",
        "statistic",
        "p_value",
        "effect_size",
        *_verdict(F.col("mean_diff"), alpha),
    )


def diebold_mariano_test(errors: DataFrame, keys: list[str], loss: str = "squared", alpha: float = 0.05) -> DataFrame:
    """Mean loss difference over its standard error, without autocorrelation terms."""
    if loss not in ("squared", "absolute"):
        raise ValueError("loss must be squared or absolute")
    a, b = F.col("err_a"), F.col("err_b")
    d = a * a - b * b if loss == "squared" else F.abs(a) - F.abs(b)
    sums = _pairs(errors).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.var_samp(d).alias("var_diff"))
    usable = (F.col("n") >= 2) & (F.col("var_diff") > 0)
    stats = sums.withColumn("statistic", F.when(usable, F.col("mean_diff") / F.sqrt(F.col("var_diff") / F.col("n"))))
    return stats.withColumn("p_value", F.coalesce(normal_tail("statistic"), F.lit(1.0))).select(
        *keys,
        F.lit("diebold_mariano").alias("test_name"),
        "n",
        "mean_diff",
        "statistic",
        "p_value",
        *_verdict(F.col("mean_diff"), alpha),
    )


def wilcoxon_signed_rank_test(errors: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Rank sums of positive and negative differences; zeros dropped, ties averaged,
    normal approximation with tie correction."""
    d = F.col("err_a") - F.col("err_b")
    sized = _pairs(errors).where(d != 0).select(*keys, F.abs(d).alias("size"), (d > 0).alias("positive"))
    ranks = tie_averaged_ranks(sized, keys, "size", {"n_pos": F.count_if("positive")})
    n = F.col("n").cast("double")
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("mean_rank") * F.col("n_pos")).alias("w_plus"),
        F.sum(F.col("mean_rank") * (F.col("n") - F.col("n_pos"))).alias("w_minus"),
        F.sum("n").alias("pairs"),
        F.sum(n * n * n - n).alias("ties"),
    )
    m = F.col("pairs").cast("double")
    variance = m * (m + 1) * (2 * m + 1) / 24.0 - F.col("ties") / 48.0
    stats = sums.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn(
        "z", F.try_divide(F.col("w_plus") - m * (m + 1) / 4.0, F.sqrt(F.nullif(variance, F.lit(0.0))))
    )
    return stats.withColumn("p_value", F.coalesce(normal_tail("z"), F.lit(1.0))).select(
        *keys,
        F.lit("wilcoxon_signed_rank").alias("test_name"),
        F.col("pairs").alias("n"),
        "w_plus",
        "w_minus",
        "statistic",
        "z",
        "p_value",
        *_verdict(F.col("z"), alpha),
    )


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add ``p_adjusted`` over all comparisons of the table that have a p-value."""
    size = tests.agg(F.count("p_value").alias("n_comparisons"))
    adjusted = F.when(F.col("p_value").isNotNull(), F.least(F.col("p_value") * F.col("n_comparisons"), F.lit(1.0)))
    return (
        tests.crossJoin(F.broadcast(size))
        .withColumn("p_adjusted", adjusted)
        .withColumn("significant_adjusted", F.coalesce(F.col("p_adjusted") < alpha, F.lit(False)))
    )


#: Cumulative probabilities of Poisson(1), as far as a draw of 32 bits can tell them from one.
POISSON_STEPS = [
    step for step in (sum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1)) for i in range(20)) if step <= 1.0 - 2.0**-32
]


def replica_weights(seed, station: str | None, replicas: int) -> np.ndarray:
    """A Poisson(1) weight of the station for every replica, drawn from labels alone."""
    back = "" if station is None else f"|{station}"
    draws = [int(md5(f"{seed}|{r}{back}".encode()).hexdigest()[:8], 16) for r in range(replicas)]
    return np.searchsorted(POISSON_STEPS, np.array(draws) / DRAW_RANGE, side="right").astype(np.float64)


#: Comparisons whose replicas a task sums before it hands them on.
_HELD = 256


def _replica_sums(sums: DataFrame, keys: list[str], replicas: int, seed) -> DataFrame:
    """Per comparison and task: sums of every replica, as arrays of the four totals end to end."""
    names = [f"__k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        weights: dict[str | None, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            columns = list(zip(*held)) if names else []
            table = {n: pd.Series(list(c), dtype=object) for n, c in zip(names, columns)}
            return pd.DataFrame({**table, "totals": [x.tobytes() for x in held.values()]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                station = row[len(names)]
                if station not in weights:
                    if len(weights) > _HELD:
                        weights.clear()
                    weights[station] = replica_weights(seed, station, replicas)
                key = tuple(row[: len(names)])
                own = np.outer(np.array(row[len(names) + 1 :], np.float64), weights[station])
                if key in held:
                    held[key] += own
                else:
                    held[key] = own
            if len(held) > _HELD:
                yield rows()
                held = {}
        if held:
            yield rows()

    schema = ", ".join([*(f"{n} string" for n in names), "totals binary"])
    shown = [F.to_json(F.struct(F.col(k).alias("x"))).alias(n) for k, n in zip(keys, names)]
    return sums.select(*shown, F.col("station_id").cast("string").alias("station"), "c", "s", "a", "q").mapInPandas(run, schema)


def bootstrap_intervals(
    errors: DataFrame, keys: list[str], error: str = "err_a", replicas: int = 1000, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Confidence limits of RMSE, MAE and bias, resampling whole stations.

    Cells are summed per station first. Each replica gives a station a Poisson(1) weight drawn from
    its label. Tasks add up all replicas of a comparison in arrays, so what is shuffled does not
    grow with the number of replicas or stations: one row per task and comparison.
    """
    e = F.col(error)
    sums = (
        errors.where(e.isNotNull())
        .groupBy(*keys, "station_id")
        .agg(F.count("*").alias("c"), F.sum(e).alias("s"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("q"))
    )
    low, high = (1.0 - level) / 2.0, (1.0 + level) / 2.0
    names = [f"__k{i}" for i in range(len(keys))]
    measures = [f"{m}_{side}" for m in ("rmse", "mae", "bias") for side in ("low", "high")]

    def limits(rows: pd.DataFrame) -> pd.DataFrame:
        c, s, a, q = sum(np.frombuffer(x).reshape(4, -1) for x in rows["totals"])
        drawn = c > 0  # a replica without any cell has no measure
        c, s, a, q = c[drawn], s[drawn], a[drawn], q[drawn]
        found = [np.quantile(m, p) if len(m) else None for m in (np.sqrt(q / c), a / c, s / c) for p in (low, high)]
        return pd.DataFrame([[*(rows[n].iloc[0] for n in names), int(drawn.sum()), *found]], columns=[*names, "replicas", *measures])

    schema = ", ".join([*(f"{n} string" for n in names), "replicas long", *(f"{m} double" for m in measures)])
    done = _replica_sums(sums, keys, replicas, seed).groupBy(*names).applyInPandas(limits, schema)
    kinds = dict(errors.dtypes)
    back = [F.from_json(n, f"x {kinds[k]}")["x"].alias(k) for k, n in zip(keys, names)]
    return done.select(*back, "replicas", *measures)
