"""Filling gaps along time: straight lines and Akima's cubic.

Both add ``filled``: the observed value, or the estimate, or NULL where an inner
gap is longer than allowed. Ends are carried from the nearest observed cell; a
series without any observed cell becomes 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import nearest_points
from .series import SERIES


POINTS = "obs"


def _side(side: str, i: int) -> tuple[Column, Column]:
    return F.col(f"{POINTS}_{side[0]}t{i + 1}"), F.col(f"{POINTS}_{side[0]}v{i + 1}")


def _with_ends(inner: Column, max_gap: int | None) -> Column:
    (lt, lv), (rt, rv) = _side("before", 0), _side("after", 0)
    if max_gap is not None:
        inner = F.when(rt - lt - 1 <= max_gap, inner)
    return (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(lt.isNull() & rt.isNull(), F.lit(0.0))
        .when(lt.isNull(), rv)
        .when(rt.isNull(), lv)
        .otherwise(inner)
    )


def add_line(around: DataFrame, name: str, max_gap: int | None = None) -> DataFrame:
    (lt, lv), (rt, rv) = _side("before", 0), _side("after", 0)
    line = lv + (rv - lv) * ((F.col("t") - lt) / (rt - lt))
    return around.withColumn(name, _with_ends(line, max_gap))


def add_carried(around: DataFrame, name: str, max_gap: int | None = None) -> DataFrame:
    return around.withColumn(name, _with_ends(_side("before", 0)[1], max_gap))


def _akima_slope(l2: np.ndarray, l1: np.ndarray, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Derivative at a point from the two slopes on each side; close weights give their mean."""
    w_left, w_right = np.abs(r2 - r1), np.abs(l1 - l2)
    total = w_left + w_right
    # Written so that NaN weights are not close.
    return np.where(~(total <= 1e-12), (w_left * l1 + w_right * r1) / total, (l1 + r1) / 2.0)


@F.arrow_udf(T.DoubleType())
def _akima_curve(t: pa.Array, *around: pa.Array) -> pa.Array:
    """Akima's cubic at ``t`` from steps and values of p2 p1 p0 | gap | n0 n1 n2; NULL without p0 or n0."""
    known = [~column.is_null().to_numpy(zero_copy_only=False) for column in around[::2]]
    p2, p1, p0, n0, n1, n2 = (
        (pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(v.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
        for at, v in zip(around[::2], around[1::2])
    )
    with np.errstate(all="ignore"):
        slope = lambda a, b: (b[1] - a[1]) / (b[0] - a[0]).astype(np.float64)
        a2, a1, m, b1, b2 = (slope(a, b) for a, b in ((p2, p1), (p1, p0), (p0, n0), (n0, n1), (n1, n2)))
        left, right = known[1] & known[2], known[3] & known[4]
        # A slope missing at an end of the series continues the two next to it: 2 · first − second.
        first = np.where(left, a1, np.where(right, 2 * m - b1, m))
        last = np.where(right, b1, np.where(left, 2 * m - a1, m))
        a2 = np.where(known[0], a2, 2 * first - m)
        b2 = np.where(known[5], b2, 2 * last - m)
        h = (n0[0] - p0[0]).astype(np.float64)
        s = (t.to_numpy(zero_copy_only=False) - p0[0]) / h
        curve = (
            (2 * s * s * s - 3 * s * s + 1) * p0[1]
            + (s * s * s - 2 * s * s + s) * h * _akima_slope(a2, first, m, last)
            + (-2 * s * s * s + 3 * s * s) * n0[1]
            + (s * s * s - s * s) * h * _akima_slope(first, m, last, b2)
        )
    return pa.array(curve, pa.float64(), mask=~(known[2] & known[3]))


def add_akima(around: DataFrame, name: str, max_gap: int | None = None) -> DataFrame:
    """Akima (1970): local cubic through three observed points on each side of the gap.

    One vectorised function: as columns the curve names every point many times over, and each filter or
    round on top of it multiplies that until plans and generated code no longer end.
    """
    points = [*(_side("before", i) for i in (2, 1, 0)), *(_side("after", i) for i in range(3))]
    curve = _akima_curve(F.coalesce("t", F.lit(0)), *[column for point in points for column in point])
    return around.withColumn(name, _with_ends(curve, max_gap))


# Method along time -> observed points needed on each side, and the step that uses them.
ALONG_TIME = {"linear": (1, add_line), "carry_forward": (1, add_carried), "akima": (3, add_akima)}


def _fill(panel: DataFrame, method: str, max_gap: int | None, keys: list[str]) -> DataFrame:
    depth, add = ALONG_TIME[method]
    around = nearest_points(panel, keys, {POINTS: (F.col("value"), depth)})
    return add(around, "filled", max_gap).select(*panel.columns, "filled")


def linear_fill(panel: DataFrame, max_gap: int | None = None, keys: list[str] = SERIES) -> DataFrame:
    return _fill(panel, "linear", max_gap, keys)


def carry_forward(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Last observed value (first one at the start): the comparison baseline of the paired tests."""
    return _fill(panel, "carry_forward", None, keys)


def akima_fill(panel: DataFrame, max_gap: int | None = None, keys: list[str] = SERIES) -> DataFrame:
    return _fill(panel, "akima", max_gap, keys)
