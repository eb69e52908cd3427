"""Synthetic gaps: random, condition dependent, value dependent and realistic.

A sample is one series with all its variables. For every sample a sequence of candidate gaps
is drawn; each cell belongs to the first candidate that covers it, and candidates are used in
order until int(ratio · steps · variables) cells are masked, the last one only in part. Draws
depend on (seed, sample, candidate) alone, so the mask is the same whatever the partitioning.

A sample is swept by one task, which keeps a byte per cell (an hourly century of ten variables: 9 MB)
and draws candidates until the target is met; samples are spread over the cluster. What comes out are
runs of cells, not cells, and no job runs while the plan is made. Runs reach a grid through one row
per masked step, joined before variables are unfolded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.draws import DRAW_RANGE
from ..session import fan_out
from .ranks import exact_quantiles
from .series import STEP_BIT, WORD, word_of

SAMPLE = "station_id"


@dataclass(frozen=True)
class MaskSpec:
    """How to mask; ``kind`` is one of mcar, mar, mnar, realistic."""

    kind: str = "mcar"
    missing_ratio: float = 0.2
    min_gap: int = 1
    max_gap: int = 168
    condition_variable: str | None = None
    extreme_percentile: float = 0.15
    extreme_multiplier: float = 5.0
    gap_distribution: str = "empirical"

    def __post_init__(self):
        if self.kind not in ("mcar", "mar", "mnar", "realistic"):
            raise ValueError(f"unknown mask kind {self.kind!r}")
        if not 0.0 <= self.missing_ratio <= 1.0:
            raise ValueError("missing_ratio must be in [0, 1]")
        if self.min_gap < 1:
            raise ValueError("min_gap must be at least 1")
        if self.max_gap < self.min_gap:
            raise ValueError("max_gap must not be below min_gap")
        if not 0.0 < self.extreme_percentile < 0.5:
            raise ValueError("extreme_percentile must be in (0, 0.5)")
        if self.extreme_multiplier <= 0.0:
            raise ValueError("extreme_multiplier must be positive")
        if self.gap_distribution not in ("empirical", "lognormal"):
            raise ValueError("gap_distribution must be empirical or lognormal")
        if self.kind in ("mar", "mnar") and self.condition_variable is None:
            raise ValueError(f"{self.kind} needs condition_variable")

    @property
    def mean_gap(self) -> float:
        if self.kind != "realistic":
            return (self.min_gap + self.max_gap) / 2.0
        if self.gap_distribution == "empirical":
            return sum(share * (low + high) / 2.0 for share, low, high in C.EMPIRICAL_GAPS)
        return math.exp(C.LOGNORMAL_GAP_MEAN + C.LOGNORMAL_GAP_STD**2 / 2.0)

    @property
    def oversampling(self) -> int:
        """Candidates per candidate strictly needed: overlap grows with the ratio."""
        ratio = min(self.missing_ratio, 0.999)
        return 4 if ratio <= 0.5 else math.ceil(4 * -math.log(1.0 - ratio) / ratio)


def sample_sizes(panel: DataFrame) -> DataFrame:
    """One row per sample: first step and number of steps. Where the grid's range is
    known, building this table from the station list saves reading the panel."""
    return panel.groupBy(SAMPLE).agg(
        F.min("t").alias("first_t"), (F.max("t") - F.min("t") + 1).cast("bigint").alias("n_steps")
    )


def _targets(samples: DataFrame, n_variables: int, ratio: float) -> DataFrame:
    return samples.withColumn("target", F.floor(F.col("n_steps") * n_variables * ratio).cast("bigint"))


class _Draws:
    """The draws of ``functions.draws`` for one sample; ``name`` is its id as text."""

    def __init__(self, seed, name: str | None):
        self.front = "|".join([str(seed)] if name is None else [str(seed), name])

    def bits(self, *labels) -> int:
        return int(md5("|".join([self.front, *map(str, labels)]).encode()).hexdigest()[:8], 16)

    def uniform(self, *labels) -> float:
        return self.bits(*labels) / DRAW_RANGE

    def whole(self, lowest: int, highest: int, *labels) -> int:
        return lowest + math.floor(self.uniform(*labels) * (highest - lowest + 1))

    def normal(self, *labels) -> float:
        first = (self.bits(*labels, "radius") + 1) / DRAW_RANGE
        return math.sqrt(-2.0 * math.log(first)) * math.cos(self.uniform(*labels, "angle") * 6.283185307179586)


def _gap_length(draws: _Draws, k: int, spec: MaskSpec) -> int:
    if spec.kind != "realistic":
        return draws.whole(spec.min_gap, spec.max_gap, k, "length")
    if spec.gap_distribution == "lognormal":
        drawn = math.floor(math.exp(C.LOGNORMAL_GAP_MEAN + C.LOGNORMAL_GAP_STD * draws.normal(k, "length")))
        return min(max(drawn, 1), C.LONGEST_REALISTIC_GAP)
    u, upto = draws.uniform(k, "category"), 0.0
    for share, low, high in C.EMPIRICAL_GAPS[:-1]:
        upto += share
        if u < upto:
            return draws.whole(low, high, k, "length")
    return draws.whole(*C.EMPIRICAL_GAPS[-1][1:], k, "length")


def _starts(draws: _Draws, spec: MaskSpec, n_steps: int, extreme, normal):
    """How a candidate's start is drawn; the lists hold the steps of either kind, in order."""
    if extreme is None:
        return lambda k: draws.whole(0, n_steps - 1, k, "start")
    if not len(extreme) + len(normal):
        return None
    p = 0.75
    if spec.kind == "mnar":
        f = len(extreme) / n_steps
        weighted = f * spec.extreme_multiplier
        p = min(0.95, max(0.05, weighted / (weighted + 1.0 - f)))

    def start(k: int) -> int:
        wants = len(extreme) > 0 and (draws.uniform(k, "class") < p or not len(normal))
        steps = extreme if wants else normal
        return int(steps[draws.whole(1, len(steps), k, "start") - 1])

    return start


def _sweep(draws: _Draws, spec: MaskSpec, n_variables: int, n_steps: int, target: int, start) -> Iterator[tuple[int, int, int, int]]:
    """Runs (k, v, first, last) of cells in the order in which candidates cover them, up to the target.

    Cells on which no candidate can fall end the sweep: once a doubling of the candidates, well beyond
    the number of cells, has brought nothing.
    """
    cells, room = n_steps * n_variables, min(target, n_steps * n_variables)
    covered = np.zeros((n_variables, n_steps), bool)
    k, mark, left_at_mark = 0, max(20 * cells, 8), room
    while room > 0 and start is not None:
        v, length, first = draws.whole(0, n_variables - 1, k, "variable"), _gap_length(draws, k, spec), start(k)
        gap = covered[v, first : first + length]
        fresh = np.flatnonzero(~gap)[:room]
        if len(fresh):
            gap[fresh] = True
            room -= len(fresh)
            cuts = np.flatnonzero(np.diff(fresh) > 1)
            for a, b in zip(fresh[np.append(0, cuts + 1)].tolist(), fresh[np.append(cuts, len(fresh) - 1)].tolist()):
                yield k, v, first + a, first + b
        k += 1
        if k >= mark:
            if room == left_at_mark:
                return
            mark, left_at_mark = 2 * mark, room


def _flagged_steps(panel: DataFrame, spec: MaskSpec) -> DataFrame:
    """Steps of the condition variable with ``is_extreme``; thresholds are over all samples."""
    name = spec.condition_variable
    if "variable" in panel.columns:
        condition = panel.where(F.col("variable") == name).select(SAMPLE, "t", "value")
    else:
        condition = panel.select(SAMPLE, "t", F.col(name).alias("value"))
    limits = exact_quantiles(condition, "value", [spec.extreme_percentile, 1.0 - spec.extreme_percentile])
    limits = limits.select(F.struct("q0", "q1")).scalar()
    outside = F.coalesce((F.col("value") < limits["q0"]) | (F.col("value") > limits["q1"]), F.lit(False))
    return condition.select(SAMPLE, "t", outside.alias("is_extreme"))


def synthetic_runs(samples: DataFrame, variables, spec: MaskSpec, seed, panel: DataFrame | None = None) -> DataFrame:
    """The masked cells as runs: ``(station_id, v, first, last, k)``, steps ``first`` to ``last`` of variable number ``v``.

    ``samples`` is laid out as by :func:`sample_sizes`. The panel itself, long or a grid with a column
    per variable, is needed only for kinds whose gaps depend on values.
    """
    n_variables = len(variables)
    sized = _targets(samples, n_variables, spec.missing_ratio).withColumn("name", F.col(SAMPLE).cast("string"))
    biased = spec.kind in ("mar", "mnar")
    if biased:
        if spec.condition_variable not in variables:
            raise ValueError(f"condition_variable must be one of {tuple(variables)}")
        if panel is None:
            raise ValueError(f"{spec.kind} masks need the panel")
        chosen = lambda flag: F.array_sort(F.collect_list(F.when(F.col("is_extreme") == flag, F.col("t").cast("bigint"))))
        steps = _flagged_steps(panel, spec).groupBy(SAMPLE).agg(chosen(True).alias("extreme"), chosen(False).alias("normal"))
        sized = sized.join(steps, SAMPLE)
    else:
        sized = sized.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("extreme", "normal")})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, n_held = [], 0
            for row in batch.to_dict("records"):
                draws, origin = _Draws(seed, row["name"]), row["first_t"]
                lists = [row[c] - origin if biased else None for c in ("extreme", "normal")]
                runs = list(_sweep(draws, spec, n_variables, row["n_steps"], row["target"], _starts(draws, spec, row["n_steps"], *lists)))
                if runs:
                    held.append((row[SAMPLE], origin, np.array(runs, np.int64)))
                    n_held += len(runs)
                if n_held >= _RUNS:
                    yield _run_table(held)
                    held, n_held = [], 0
            if held:
                yield _run_table(held)

    # An explicit number of partitions: this small table stands for much work. The second column keeps it: where
    # ids come out of a shuffle by id, one by id alone is taken for the same, and folded into a single task.
    spread = sized.where(f"target > 0 AND {SAMPLE} IS NOT NULL").select(SAMPLE, "name", "first_t", "n_steps", "target", "extreme", "normal")
    kind = dict(samples.dtypes)[SAMPLE]
    return spread.repartition(fan_out(samples.sparkSession), SAMPLE, "name").mapInPandas(
        sweep, f"{SAMPLE} {kind}, v int, first bigint, last bigint, k bigint"
    )


#: Runs that a task hands on at a time.
_RUNS = 65_536


def _run_table(held: list[tuple]) -> pd.DataFrame:
    """The runs of several samples, each with its id and first step, as one table."""
    counts = [len(runs) for *_, runs in held]
    origin = np.repeat(np.array([first for _, first, _ in held], np.int64), counts)
    k, v, first, last = np.concatenate([runs for *_, runs in held]).T
    ids = pd.Series([sample for sample, *_ in held]).repeat(counts).reset_index(drop=True)
    return pd.DataFrame({SAMPLE: ids, "v": v, "first": first + origin, "last": last + origin, "k": k})


def run_cells(runs: DataFrame, variables) -> DataFrame:
    """The cells of runs: ``(station_id, t, variable, k)``."""
    names = F.array(*[F.lit(v) for v in variables])
    steps = F.explode(F.sequence("first", "last")).alias("t")
    return runs.select(SAMPLE, steps, "v", "k").select(SAMPLE, F.col("t").cast("int").alias("t"), F.get(names, F.col("v")).alias("variable"), "k")


def synthetic_mask(samples: DataFrame, variables, spec: MaskSpec, seed, panel: DataFrame | None = None) -> DataFrame:
    """The masked cells: ``(station_id, t, variable, k)``, each once; arguments as of :func:`synthetic_runs`."""
    return run_cells(synthetic_runs(samples, variables, spec, seed, panel), variables)


#: Variables whose marks fit one number.
_WORD = 62


def hidden_steps(runs: DataFrame, n_variables: int) -> DataFrame:
    """One row per step with a masked cell; variable v is marked by bit v % 62 of column ``hidden{v // 62}``."""
    steps = runs.select(SAMPLE, F.explode(F.sequence("first", "last")).alias("t"), "v").withColumn("t", F.col("t").cast("int"))
    marks = []
    for word in range(-(-n_variables // _WORD)):
        bit = F.when(F.floor(F.col("v") / _WORD) == word, F.expr(f"shiftleft(1L, v - {word * _WORD})"))
        marks.append(F.bit_or(bit).alias(f"hidden{word}"))
    return steps.groupBy(SAMPLE, "t").agg(*marks)


def hide_in_grid(grid: DataFrame, variables, runs: DataFrame) -> DataFrame:
    """The grid (a row per station and step, a column per variable) and marks of what ``runs`` hide, see :func:`is_hidden`."""
    return grid.join(hidden_steps(runs, len(variables)), [SAMPLE, "t"], "left")


def is_hidden(v: int) -> Column:
    """Whether variable number ``v`` is masked in a row of :func:`hide_in_grid`."""
    return F.coalesce(F.expr(f"(hidden{v // _WORD} & {1 << (v % _WORD)}L) <> 0"), F.lit(False))


def hidden_panel(grid: DataFrame, variables, runs: DataFrame) -> DataFrame:
    """As :func:`apply_mask` gives it, from a grid: masks are joined once per step, and variables unfolded after that."""
    joined = hide_in_grid(grid, variables, runs)
    keys = [c for c in grid.columns if c not in variables]
    cells = [
        F.struct(F.lit(name).alias("variable"), F.col(name).cast("double").alias("truth"), is_hidden(v).alias("is_synthetic"))
        for v, name in enumerate(variables)
    ]
    hidden = F.col("is_synthetic")
    return joined.select(*keys, F.inline(F.array(*cells))).select(
        *keys,
        "variable",
        "truth",
        F.when(~hidden, F.col("truth")).alias("value"),
        "is_synthetic",
        (hidden & F.col("truth").isNotNull()).alias("is_eval"),
    )


def masked_grid(grid: DataFrame, variables, runs: DataFrame) -> DataFrame:
    """The grid with NULL where masked."""
    values = [F.when(~is_hidden(v), F.col(name)).alias(name) for v, name in enumerate(variables)]
    return hide_in_grid(grid, variables, runs).select(*[c for c in grid.columns if c not in variables], *values)


def apply_mask(panel: DataFrame, mask: DataFrame) -> DataFrame:
    """Panel with ``truth`` (as observed), ``value`` (NULL where masked), ``is_synthetic`` and
    ``is_eval`` (observed and masked: the cells to score)."""
    marked = mask.select("station_id", "t", "variable", F.lit(True).alias("__hit"))
    joined = panel.join(marked, ["station_id", "t", "variable"], "left")
    hidden = F.col("__hit").isNotNull()
    return joined.select(
        *[c for c in panel.columns if c != "value"],
        F.col("value").alias("truth"),
        F.when(~hidden, F.col("value")).alias("value"),
        hidden.alias("is_synthetic"),
        (hidden & F.col("value").isNotNull()).alias("is_eval"),
    )


def cells_under_masks(panel: DataFrame, drawn: dict[str, DataFrame], name: str = "strategy") -> DataFrame:
    """Every cell of the panel once per mask: ``(name, station_id, variable, t, hidden)``.

    Cells of the panel (each once, none without a step) and of all masks meet as bits of words of steps,
    combined before the shuffle, and become rows after it.
    """
    word = [SAMPLE, "variable", word_of().alias("__w")]
    every = [panel, *drawn.values()]
    marked = reduce(DataFrame.unionByName, [df.select(SAMPLE, "variable", "t", F.lit(i).alias("__of")) for i, df in enumerate(every)])
    bits = [F.coalesce(F.bit_or(F.when(F.col("__of") == i, F.expr(STEP_BIT))), F.lit(0)).alias(f"__bits{i}") for i in range(len(every))]
    # An explicit number of partitions: this small table stands for many cells.
    packed = marked.groupBy(*word).agg(*bits).repartition(fan_out(panel.sparkSession), SAMPLE, "variable", "__w")
    steps = F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(__bits0, i) & 1L) = 1)")
    cells = packed.withColumn("__i", F.explode(steps))
    hidden = [
        F.struct(F.lit(x).alias(name), F.expr(f"(shiftright(__bits{i}, __i) & 1L) = 1").alias("hidden")) for i, x in enumerate(drawn, 1)
    ]
    t = (F.col("__w") * WORD + F.col("__i")).cast(dict(panel.dtypes)["t"]).alias("t")
    return cells.select(SAMPLE, "variable", t, F.inline(F.array(*hidden))).select(name, SAMPLE, "variable", "t", "hidden")


def mask_totals(samples: DataFrame, mask: DataFrame, n_variables: int, ratio: float) -> DataFrame:
    """Per sample: target and reached number of cells."""
    wanted = _targets(samples, n_variables, ratio).select(SAMPLE, "target")
    reached = mask.groupBy(SAMPLE).agg(F.count("*").alias("masked"))
    return wanted.join(reached, SAMPLE, "left").select(SAMPLE, "target", F.coalesce("masked", F.lit(0)).alias("masked"))


def holdout_masks(mask: DataFrame) -> DataFrame:
    """Two disjoint masks from one: even candidates for validation, odd ones for test."""
    return mask.withColumn("holdout", F.when(F.pmod("k", F.lit(2)) == 0, "val").otherwise("test"))
