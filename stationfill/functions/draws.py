"""Repeatable random numbers: a draw depends on its labels only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = float(1 << 32)


def digest(*labels) -> Column:
    parts = [label if isinstance(label, Column) else F.lit(str(label)) for label in labels]
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))


def draw_bits(*labels) -> Column:
    """Whole number in [0, 2^32)."""
    return F.conv(F.substring(digest(*labels), 1, 8), 16, 10).cast("bigint")


def uniform(*labels) -> Column:
    """Double in [0, 1)."""
    return draw_bits(*labels) / F.lit(DRAW_RANGE)


def uniform_int(lowest, highest, *labels) -> Column:
    """Whole number in [lowest, highest]."""
    lowest, highest = (x if isinstance(x, Column) else F.lit(x) for x in (lowest, highest))
    return (lowest + F.floor(uniform(*labels) * (highest - lowest + 1))).cast("bigint")


def standard_normal(*labels) -> Column:
    """Box-Muller on two independent draws; the first is kept above zero."""
    first = (draw_bits(*labels, "radius") + 1) / F.lit(DRAW_RANGE)
    second = uniform(*labels, "angle")
    return F.sqrt(-2.0 * F.ln(first)) * F.cos(second * 6.283185307179586)
