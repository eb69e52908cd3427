"""Angles in degrees: encoding, differences and aggregate means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction_sin(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def direction_cos(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def direction_from(sine: Column, cosine: Column) -> Column:
    """Angle in [0, 360) of a sine/cosine pair."""
    return F.pmod(F.degrees(F.atan2(sine, cosine)), F.lit(360.0))


def angular_difference(start: Column, end: Column) -> Column:
    """Shortest signed turn from ``start`` to ``end``; opposite angles give -180."""
    return F.pmod(end - start + 180.0, F.lit(360.0)) - 180.0


def circular_mean(degrees: Column) -> Column:
    """Aggregate: mean direction, NULL cells left out."""
    return direction_from(F.sum(direction_sin(degrees)), F.sum(direction_cos(degrees)))


def circular_std(degrees: Column) -> Column:
    """Aggregate: circular standard deviation in radians, resultant length kept in [1e-7, 1]."""
    sine, cosine = F.avg(direction_sin(degrees)), F.avg(direction_cos(degrees))
    resultant = F.least(F.greatest(F.sqrt(sine * sine + cosine * cosine), F.lit(1e-7)), F.lit(1.0))
    return F.sqrt(-2.0 * F.ln(resultant))
