"""Regular grids, gaps, windows and time segments of a long panel.

A panel has ``station_id, t, variable, value`` (NULL = missing), one row per cell,
``t`` a whole number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .blocks import BLOCK, explode_range, nearest_points, with_bounds

SERIES = ["station_id", "variable"]


def hour_index(ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Whole hours since ``origin``."""
    start = F.lit(origin).cast("timestamp_ntz").cast("timestamp")
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start)
    return F.floor(micros / F.lit(3_600_000_000)).cast("bigint")


def first_per_step(reports: DataFrame, variables) -> DataFrame:
    """One row per (station, step): of each variable the earliest reported value.

    Copies of one report fold together before the shuffle.
    """
    earliest = [F.min(F.when(F.col(v).isNotNull(), F.struct("ts", F.col(v).cast("double").alias("x"))))["x"].alias(v) for v in variables]
    return reports.groupBy("station_id", "t").agg(*earliest)


def unfold(wide: DataFrame, variables, keys, name: str = "value") -> DataFrame:
    """One row per variable. Keys pass through unchanged, so filters on them still reach the source."""
    cells = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias(name)) for v in variables]
    return wide.select(*keys, F.inline(F.array(*cells)))


def wide_grid(
    cells: DataFrame, variables, first: int | None = None, last: int | None = None, stations: DataFrame | None = None
) -> DataFrame:
    """Every step of every station, one column per variable, NULL where missing.

    ``cells`` has one row per station and step (see :func:`first_per_step`). The range is the
    station's own, or ``first``..``last`` when given; ``stations`` then names the stations if listing
    them from the cells is not wanted. With columns ``first_t`` and ``n_steps`` it gives their ranges too.
    """
    if (first is None) != (last is None):
        raise ValueError("give both first and last, or neither")
    if stations is not None and {"first_t", "n_steps"} <= set(stations.columns):
        ends = stations.select("station_id", F.col("first_t").alias("lo"), (F.col("first_t") + F.col("n_steps") - 1).alias("hi"))
    elif first is None:
        ends = cells.groupBy("station_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    else:
        listed = cells if stations is None else stations
        ends = listed.select("station_id").distinct().withColumn("lo", F.lit(first)).withColumn("hi", F.lit(last))
    steps = explode_range(ends, ["station_id"], F.col("lo"), F.col("hi")).select("station_id", F.col("t").cast("int").alias("t"))
    # Steps come from ``explode``, which Spark takes for as large as what went in: where a filter makes the join an inner one
    # it would broadcast them.
    return steps.join(cells.select("station_id", "t", *variables).hint("merge"), ["station_id", "t"], "left")


def regular_grid(
    cells: DataFrame, variables, first: int | None = None, last: int | None = None, stations: DataFrame | None = None
) -> DataFrame:
    """Every step of every station and variable, missing ones with a NULL value: :func:`wide_grid`, unfolded after its join."""
    return unfold(wide_grid(cells, variables, first, last, stations), variables, ["station_id", "t"])


def gap_columns(df: DataFrame, points: str) -> DataFrame:
    """``gap_start`` and ``gap_length`` of the run a cell lies in, from its neighbours and the series' ends."""
    start = F.coalesce(F.col(f"{points}_bt1") + 1, F.col("first_t"))
    end = F.coalesce(F.col(f"{points}_at1") - 1, F.col("last_t"))
    return df.withColumn("gap_start", start).withColumn("gap_length", (end - start + 1).cast("bigint"))


def _around(panel: DataFrame, keys: list[str]) -> DataFrame:
    observed = F.when(F.col("value").isNotNull(), F.lit(True))
    return gap_columns(nearest_points(panel, keys, {"obs": (observed, 1)}, bounds=True), "obs")


def gap_runs(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """One row per maximal run of missing cells: ``(keys, start_t, length)``."""
    missing = _around(panel, keys).where(F.col("value").isNull() & (F.col("t") == F.col("gap_start")))
    return missing.select(*keys, F.col("gap_start").alias("start_t"), F.col("gap_length").alias("length"))


def gap_lengths(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Add ``gap_length``: the length of the run a missing cell lies in, 0 where observed."""
    length = F.when(F.col("value").isNull(), F.col("gap_length")).otherwise(F.lit(0)).cast("bigint")
    return _around(panel, keys).select(*panel.columns, length.alias("gap_length"))


#: Steps that one number has a bit for, its sign and one bit to spare.
WORD = 62
#: The bit of a step in its word.
STEP_BIT = f"shiftleft(1L, cast(pmod(cast(t AS bigint), {WORD}) AS int))"


def word_of(t: str = "t") -> Column:
    return F.floor(F.col(t) / F.lit(WORD))


def _lowest(bits: str) -> str:
    return f"bit_count(({bits} & -{bits}) - 1)"


def _counted_runs(panel: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows ``(by, length, cells, missing, gaps)``: cells without a length, and runs that start, by their length.

    A word of 62 steps is one row: what is observed and what is missing are bits, combined before the
    shuffle, so cells are not sent, and neighbours are looked for among words.
    """
    missing, bit = F.col("value").isNull(), F.expr(STEP_BIT)
    words = panel.groupBy(*keys, word_of().alias("__w")).agg(
        F.count("*").alias("__cells"),
        F.count_if(missing).alias("__missing"),
        F.coalesce(F.bit_or(F.when(~missing, bit)), F.lit(0)).alias("__seen"),
        F.coalesce(F.bit_or(F.when(missing, bit)), F.lit(0)).alias("__gone"),
        F.min("t").alias("__from"),
        F.max("t").alias("__to"),
    )
    seen = F.when(F.col("__seen") != 0, F.col("__seen"))
    near = nearest_points(words, keys, {"obs": (seen, 1)}, t="__w", bounds=True, ends=("__from", "__to"))
    # A run starts after an observed step or at the first of the series; rows with a NULL key or step have no first.
    carried = f"if(obs_bt1 = __w - 1 AND shiftright(obs_bv1, {WORD - 1}) = 1, 1L, 0L)"
    first = f"if(first_t >= __w * {WORD}, shiftleft(1L, cast(first_t - __w * {WORD} AS int)), 0L)"
    start = F.expr(f"if(first_t IS NULL, 0L, __gone & (shiftleft(__seen, 1) | {carried} | {first}))")
    # The next observed step, or what follows the last one, counted from the first step of the word.
    beyond = F.expr(f"coalesce(obs_at1 * {WORD} + {_lowest('obs_av1')}, last_t + 1) - __w * {WORD}")
    behind = "(__seen & shiftleft(-1L, i + 1))"
    length = f"if({behind} <> 0, {_lowest(behind)}, __beyond) - i"
    runs = F.expr(
        f"transform(filter(sequence(0, {WORD - 1}), i -> (shiftright(__start, i) & 1L) = 1), "
        f"i -> struct(cast({length} AS bigint) AS length, 0L AS cells, 0L AS missing, 1L AS gaps))"
    )
    cells = F.struct(
        F.lit(None).cast("bigint").alias("length"), F.col("__cells").alias("cells"), F.col("__missing").alias("missing"), F.lit(0).cast("bigint").alias("gaps")
    )
    return near.withColumns({"__start": start, "__beyond": beyond}).select(*by, F.inline(F.concat(F.array(cells), runs)))


def gap_statistics(panel: DataFrame, keys: list[str] = SERIES, by: list[str] | None = None) -> DataFrame:
    """Cells, missing share and run lengths per group.

    One pass counts cells and, by their length, the runs that start in a word of steps, so the
    median's state holds distinct lengths only. Where groups cut through series, cells themselves are looked at.
    """
    by = keys if by is None else by
    if set(by) <= set(keys):
        rows = _counted_runs(panel, keys, by)
    else:
        starts = F.col("value").isNull() & (F.col("t") == F.col("gap_start"))
        rows = _around(panel, keys).select(
            *by,
            F.when(starts, F.col("gap_length")).alias("length"),
            F.lit(1).alias("cells"),
            F.col("value").isNull().cast("int").alias("missing"),
            F.coalesce(starts, F.lit(False)).cast("int").alias("gaps"),
        )
    counted = rows.groupBy(*by, "length").agg(*[F.sum(c).alias(c) for c in ("cells", "missing", "gaps")])
    stats = counted.groupBy(*by).agg(
        F.sum("cells").alias("n_cells"),
        F.sum("missing").alias("n_missing"),
        F.sum("gaps").alias("n_gaps"),
        F.try_divide(F.sum(F.col("length") * F.col("gaps")), F.sum("gaps")).alias("mean_length"),
        F.percentile("length", F.lit(0.5), F.col("gaps")).alias("median_length"),
        F.max("length").alias("max_length"),
    )
    share = (F.col("n_missing") * F.lit(100.0) / F.col("n_cells")).alias("missing_pct")
    return stats.select(*by, "n_cells", "n_missing", share, "n_gaps", "mean_length", "median_length", "max_length")


def gap_category(length: Column) -> Column:
    return (
        F.when(length <= C.SHORT_GAP_HOURS, "short").when(length <= C.MEDIUM_GAP_HOURS, "medium").otherwise("long")
    )


def gap_categories(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy(gap_category(F.col("length")).alias("category"))
        .agg(F.count("*").alias("n_gaps"), F.sum("length").alias("total_hours"))
        .orderBy(F.col("n_gaps").desc(), "category")
    )


def sliding_windows(panel: DataFrame, window: int = 168, stride: int = 24, keys: list[str] = SERIES) -> DataFrame:
    """Each cell once per window that covers it, with ``window_start`` and ``pos``.

    Starts are counted from the first step of the series; windows running past its
    end are left out. Cells become several rows in place, nothing is grouped.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    p = F.col("t") - F.col("first_t")
    length = F.col("last_t") - F.col("first_t") + 1
    lowest = F.greatest(F.ceil((p - window + 1) / F.lit(stride)), F.lit(0))
    highest = F.least(F.floor(p / F.lit(stride)), F.floor((length - window) / F.lit(stride)))
    bounded = with_bounds(panel, keys).withColumn("__lo", lowest.cast("int")).withColumn("__hi", highest.cast("int"))
    numbered = bounded.where(F.col("__lo") <= F.col("__hi")).withColumn("__w", F.explode(F.sequence("__lo", "__hi")))
    offset = F.col("__w") * stride
    return numbered.select(
        *panel.columns,
        (F.col("first_t") + offset).cast("int").alias("window_start"),
        (p - offset).cast("int").alias("pos"),
    )


def packed_windows(windows: DataFrame) -> DataFrame:
    """One row per window and variable; ``cells`` holds at most ``window`` entries in time order.

    Missing cells carry 0 and ``mask`` false.
    """
    cell = F.struct("pos", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("mask"))
    return windows.groupBy("station_id", "window_start", "variable").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def window_arrays(panel: DataFrame, window: int = 168, stride: int = 24, keys: list[str] = SERIES, width: int = BLOCK) -> DataFrame:
    """The rows of ``packed_windows(sliding_windows(...))``: ``(keys, window_start, cells)``.

    A series is cut into blocks of steps. Each block is sent once, with the first window - 1 steps of
    what follows, and windows are sliced from its array: a cell is shuffled 1 + window / width
    times, however many windows cover it. The panel is a grid: every step of a series is there.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    width = -(-max(width, window) // stride) * stride
    p = F.col("t") - F.col("first_t")
    own = F.floor(p / F.lit(width))
    # A cell in the first window - 1 steps of its block belongs to windows that begin in the block before, too.
    halo = (F.pmod(p, F.lit(width)) < window - 1) & (own > 0)
    cell = F.struct(p.cast("int").alias("p"), F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("mask"))
    sent = with_bounds(panel, keys).select(
        *keys, "first_t", "last_t", cell.alias("cell"), F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))).alias("__b")
    )
    packed = sent.groupBy(*keys, "first_t", "last_t", "__b").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    first = F.col("__b") * width
    length = F.col("last_t") - F.col("first_t") + 1
    last = F.least(first + width - 1, length - window)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    cut = packed.select(*keys, "first_t", "__b", "cells", F.explode(starts).alias("__start"))
    sliced = F.slice("cells", (F.col("__start") - F.col("__b") * width + 1).cast("int"), F.lit(window))
    return cut.select(
        *keys,
        (F.col("first_t") + F.col("__start")).cast("int").alias("window_start"),
        F.transform(
            sliced, lambda c: F.struct((c["p"] - F.col("__start")).cast("int").alias("pos"), c["value"].alias("value"), c["mask"].alias("mask"))
        ).alias("cells"),
    )


SEGMENTS = ("train", "val", "test")


def temporal_segments(
    panel: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, keys: list[str] = SERIES
) -> DataFrame:
    """Add ``segment``: the first int(n·train) steps train, the next int(n·val) val, the rest test."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")
    n = F.col("last_t") - F.col("first_t") + 1
    p = F.col("t") - F.col("first_t")
    n_train, n_val = F.floor(n * train), F.floor(n * val)
    segment = F.when(p < n_train, "train").when(p < n_train + n_val, "val").otherwise("test")
    return with_bounds(panel, keys).select(*panel.columns, segment.alias("segment"))


def take_segment(segmented: DataFrame, segment: str) -> DataFrame:
    if segment not in SEGMENTS:
        raise ValueError(f"segment must be one of {SEGMENTS}")
    return segmented.where(F.col("segment") == segment)


def year_blocks(df: DataFrame, blocks=(("train", 1973, 2015), ("val", 2016, 2018), ("test", 2019, 2023)), ts: str = "ts") -> DataFrame:
    """Add ``segment`` by calendar year; rows of other years are left out."""
    year = F.year(ts)
    label = F.coalesce(*[F.when(year.between(low, high), name) for name, low, high in blocks])
    return df.withColumn("segment", label).where(F.col("segment").isNotNull())


def held_out_years(df: DataFrame, share: float, seed, ts: str = "ts") -> DataFrame:
    """Add ``segment``: whole years picked by hash are test, the others train."""
    from ..functions.draws import uniform

    return df.withColumn("segment", F.when(uniform(seed, F.year(ts)) < share, "test").otherwise("train"))


