"""Looking along a series without putting the series into one task.

A series is cut into blocks of ``BLOCK`` steps. Rows meet only their own block;
what lies outside comes from a per-block summary that is carried along the
series. With one cell per hour a series spanning the whole calendar (years 1 to
9999) has fewer than 22,000 block summaries, so neither side grows with the share
of rows a single station holds.

``t`` must be unique per key: lay raw reports on a grid first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fan_out

BLOCK = 4096
_BLK = "__blk"
_PRESENT = "__present"


def block_of(t: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(t) / F.lit(width))


def _blocked(df: DataFrame, keys, t: str, width: int) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that name a row's block, and their names.

    They are never NULL, so both readers of the shuffle have one plan and it is reused. Rows
    with a NULL key or step are kept in blocks of their own, apart from every series.
    """
    kinds = dict(df.dtypes)
    present = F.col(t).isNotNull()
    for name in keys:
        present = present & F.col(name).isNotNull()
    named = {
        f"__key{i}": F.coalesce(F.col(name), F.lit("" if kinds[name] == "string" else 0).cast(kinds[name]))
        for i, name in enumerate(keys)
    }
    blocked = df.withColumns({**named, _PRESENT: present, _BLK: F.coalesce(block_of(t, width), F.lit(-1))})
    return blocked, [*named, _PRESENT, _BLK]


def _tied(t: str, kind: str, held: str) -> Column:
    """The step itself, worked out from ``held`` so that the optimiser keeps the column; no row depends on its value."""
    return F.col(t) + F.coalesce(F.col(held).bitwiseAND(F.lit(0)), F.lit(0)).cast(kind)


def _before(keys, order, descending=False):
    by = F.col(order).desc() if descending else F.col(order)
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def nearest_points(
    df: DataFrame,
    keys: list[str],
    points: dict[str, tuple[Column, int]],
    t: str = "t",
    bounds: bool = False,
    width: int = BLOCK,
    ends: tuple[str, str] | None = None,
) -> DataFrame:
    """The nearest points strictly before and after each row, for each name in ``points``.

    ``points`` gives a payload and a depth per name; a point is a row with a non-NULL
    payload. Added are step and payload of the i-th nearest point, NULL when there is
    none: ``{name}_bt{i}``, ``{name}_bv{i}`` before and ``{name}_at{i}``, ``{name}_av{i}``
    after, i from 1 to the depth. ``bounds`` also adds ``first_t`` and ``last_t`` of the
    whole series: the least and the largest step or, of columns named in ``ends``, of these.

    All names share one shuffle of the rows, on (keys, block). The block summary reads
    that same shuffle when both readers hold the same columns, which a hash over all of
    them brings about; results do not depend on it, and no row is filtered. Rows with a
    NULL key or step stay and have no neighbours. Select the needed columns before calling.
    """
    columns = df.columns
    blocked, inner = _blocked(df, keys, t, width)
    rows = blocked.repartition(*inner)
    points = {name: (F.when(F.col(_PRESENT), payload), depth) for name, (payload, depth) in points.items()}
    whole_row = F.xxhash64(*columns)
    sides = {"b": "lag", "a": "lead"}

    # One sort and one window for all names, sides and depths: the i-th row before or after that has a point.
    held = {f"__at_{name}": F.when(payload.isNotNull(), F.struct(F.col(t).alias("t"), payload.alias("v"))) for name, (payload, _) in points.items()}
    over = "OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in inner) + f" ORDER BY `{t}`)"
    found = {
        f"__{name}_{side}_{i}": F.expr(f"{step}(`__at_{name}`, {i}) IGNORE NULLS {over}")
        for side, step in sides.items()
        for name, (_, depth) in points.items()
        for i in range(1, depth + 1)
    }
    near = rows.withColumns({**held, "__whole": whole_row}).withColumns(found)
    near = near.withColumns(
        {
            f"{name}_{side}{part}{i}": F.col(f"__{name}_{side}_{i}")[part]
            for side in sides
            for name, (_, depth) in points.items()
            for i in range(1, depth + 1)
            for part in "tv"
        }
    )
    carry = _carried(rows, inner, points, t, whole_row, (ends or (t, t)) if bounds else None)
    joined = near.join(carry, inner, "left")
    kind = dict(df.dtypes)[t]
    merged = {}
    for side in sides:
        for name, (_, depth) in points.items():
            for i in range(1, depth + 1):
                for part in "tv":
                    merged[f"{name}_{side}{part}{i}"] = _own_or_outer(name, side, part, i)
    # The inputs of every column are those before any is replaced, so all are replaced at once.
    out = joined.select(*[c for c in joined.columns if c not in merged], *[c.alias(n) for n, c in merged.items()])
    # Whatever of a row is read later, both readers of the shuffle hold all of it.
    out = out.withColumn(t, _tied(t, kind, "__largest")).withColumn(t, _tied(t, kind, "__whole"))
    return out.select(*columns, *merged, *(["first_t", "last_t"] if bounds else []))


def _own_or_outer(name: str, side: str, part: str, i: int) -> Column:
    """The i-th nearest point: the block's own, or the one carried in that follows the block's last."""
    own = lambda k: F.col(f"{name}_{side}t{k}").isNotNull()
    outer = lambda k: F.col(f"__{name}_{side}{part}{k}")
    chosen = F.when(own(i), F.col(f"{name}_{side}{part}{i}"))
    for k in range(i - 1, 0, -1):
        chosen = chosen.when(own(k), outer(i - k))
    return chosen.otherwise(outer(i))


def _end_points(payload: Column, t: str, side: str, depth: int) -> Column:
    """The points of a block that are nearest to its end (``b``) or start (``a``), nearest first, as an array.

    A block's points are sorted as they are grouped, so no window is needed: the array is as long as the block at most.
    """
    if depth == 1:
        at = F.when(payload.isNotNull(), F.col(t))
        pick, end = (F.max_by, F.max) if side == "b" else (F.min_by, F.min)
        found = F.struct(end(at).alias("t"), pick(payload, at).alias("v"))
        return F.when(F.count(payload) > 0, F.array(found))
    point = F.when(payload.isNotNull(), F.struct(F.col(t).alias("t"), payload.alias("v")))
    ordered = F.sort_array(F.collect_list(point), asc=side == "a")
    return F.when(F.count(payload) > 0, F.slice(ordered, 1, depth))


def _carried(rows: DataFrame, inner: list[str], points, t: str, whole_row: Column, bounds: tuple[str, str] | None) -> DataFrame:
    """One row per block: for every name and side, the points that lie beyond the block, nearest first."""
    aggregates = [F.max(whole_row).alias("__largest")]
    for name, (payload, depth) in points.items():
        aggregates += [_end_points(payload, t, side, depth).alias(f"__own_{name}_{side}") for side in "ba"]
    if bounds:
        aggregates += [F.min(bounds[0]).alias("__lo"), F.max(bounds[1]).alias("__hi")]
    summary = rows.groupBy(*inner).agg(*aggregates)
    keys = inner[:-1]
    windows = {"b": _before(keys, _BLK), "a": _before(keys, _BLK, descending=True)}
    for name, (_, depth) in points.items():
        for side, window in windows.items():
            summary = summary.withColumn("__own", F.col(f"__own_{name}_{side}")).withColumn("__run", F.col("__own"))
            for _ in range(depth - 1):
                earlier = F.last("__run", ignorenulls=True).over(window)
                longer = F.slice(F.concat("__own", F.coalesce(F.col("__earlier"), F.array())), 1, depth)
                summary = summary.withColumn("__earlier", earlier).withColumn("__run", F.when(F.col("__own").isNotNull(), longer))
            summary = summary.withColumn(f"__{name}_{side}", F.last("__run", ignorenulls=True).over(window))
    whole = Window.partitionBy(*keys)
    known = lambda c: F.when(F.col(_PRESENT), c)
    ends = [known(F.min("__lo").over(whole)).alias("first_t"), known(F.max("__hi").over(whole)).alias("last_t")] if bounds else []
    carried = [
        F.get(f"__{name}_{side}", F.lit(i - 1))[part].alias(f"__{name}_{side}{part}{i}")
        for name, (_, depth) in points.items()
        for side in "ba"
        for part in "tv"
        for i in range(1, depth + 1)
    ]
    return summary.select(*inner, "__largest", *carried, *ends)


def running_sum(
    df: DataFrame, keys: list[str], amount: Column, t: str = "t", name: str = "position", width: int = BLOCK
) -> DataFrame:
    """Add ``name``, the sum of ``amount`` up to and including this row, and ``{name}_total``.

    Both are NULL in rows with a NULL key or step.
    """
    columns, kind = df.columns, dict(df.dtypes)[t]
    blocked, inner = _blocked(df, keys, t, width)
    rows = blocked.withColumn("__amount", F.coalesce(amount.cast("bigint"), F.lit(0))).repartition(*inner)
    # As in nearest_points: both readers of the shuffle hold the same columns.
    whole_row = F.xxhash64(*columns, "__amount")
    summary = rows.groupBy(*inner).agg(F.sum("__amount").alias("__n"), F.max(whole_row).alias("__largest"))
    carry = summary.select(
        *inner,
        "__largest",
        F.coalesce(F.sum("__n").over(_before(inner[:-1], _BLK)), F.lit(0)).alias("__earlier"),
        F.when(F.col(_PRESENT), F.sum("__n").over(Window.partitionBy(*inner[:-1]))).alias(f"{name}_total"),
    )
    upto = Window.partitionBy(*inner).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("__whole", whole_row)
        .join(carry, inner, "left")
        .withColumn(name, F.when(F.col(_PRESENT), F.col("__earlier") + F.sum("__amount").over(upto)))
        .withColumn(t, _tied(t, kind, "__largest"))
        .withColumn(t, _tied(t, kind, "__whole"))
        .select(*columns, name, f"{name}_total")
    )


def with_bounds(df: DataFrame, keys: list[str], t: str = "t", width: int = BLOCK) -> DataFrame:
    """Add ``first_t`` and ``last_t`` of each series.

    The one-row-per-series table is repeated per block before the join, so the
    rows of a long series meet it in many tasks. Rows with a NULL key stay, without bounds.
    """
    ends = df.groupBy(*keys).agg(F.min(t).alias("first_t"), F.max(t).alias("last_t"))
    per_block = ends.withColumn(
        _BLK, F.explode(F.sequence(F.floor(F.col("first_t") / F.lit(width)), F.floor(F.col("last_t") / F.lit(width))))
    )
    return df.withColumn(_BLK, block_of(t, width)).join(per_block, [*keys, _BLK], "left").select(*df.columns, "first_t", "last_t")


def explode_range(df: DataFrame, keys: list[str], first: Column, last: Column, t: str = "t", width: int = BLOCK) -> DataFrame:
    """One row per whole number in [first, last] of each row; ``keys`` identify the rows.

    Two steps: block numbers first, spread over the cluster, then the numbers of
    one block, so no task writes a whole long range.
    """
    columns = df.columns
    n = fan_out(df.sparkSession)
    blocks = (
        df.withColumn("__first", first.cast("bigint"))
        .withColumn("__last", last.cast("bigint"))
        .where(F.col("__first") <= F.col("__last"))
        .withColumn(
            _BLK, F.explode(F.sequence(F.floor(F.col("__first") / F.lit(width)), F.floor(F.col("__last") / F.lit(width))))
        )
        .repartition(n, *keys, _BLK)
    )
    start = F.greatest("__first", F.col(_BLK) * width)
    end = F.least("__last", (F.col(_BLK) + 1) * width - 1)
    return blocks.withColumn(t, F.explode(F.sequence(start, end))).select(*columns, t)
