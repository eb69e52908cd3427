"""Random forests for chained equations, learned from one pass over the rows each.

A tree asks of a feature only which of 32 ranges it lies in, so rows that agree in all ranges are one
cell to every tree. Tasks add up weights and weighted labels per tree and cell; what a tree needs at any
depth follows from that table, so the rows are read once per forest and not once per level. A cell's table
has 32 entries per further variable: beyond ``MAX_CELLS`` Spark ML learns the forests (``chained``).

The forests are those of Spark ML in kind: rows are drawn with Poisson weights per tree, a node looks at a
third of the features, drawn anew, splits by variance, and leaves hold means. Ranges are cut at equal
counts over all rows the forest learns from, not over a sample: counts of some eight thousand fine ranges
are kept per variable, and what a forest changes in them follows from its cells.

Draws depend on the seed, the forest, the tree and the row's keys only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import Scratch, setting

#: Ranges of a feature, and cells of a forest at most.
RANGES, MAX_CELLS = 32, 1 << 15
#: Fine ranges of a variable: so many by count and so many by width.
FINE = 4096
#: Rows that a task works on at a time.
CHUNK = 1 << 17
_MISSING, _KEY, _NONE = "__missing", "__key", "__none"
#: Packs that a reader holds at a time.
PACKS = 8


def fits(n_variables: int) -> bool:
    return n_variables >= 2 and RANGES ** (n_variables - 1) <= MAX_CELLS


@dataclass
class Tree:
    """Nodes in the order of their making: feature asked (-1 in leaves), last range that goes left, children, mean."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    value: list[float]


@dataclass
class CellForest:
    """A forest of one target: ``cuts`` are the upper ends of the ranges, by feature."""

    target: int
    features: list[int]
    cuts: list[list[float]]
    trees: list[Tree]

    def table(self) -> np.ndarray:
        """The mean of the trees in every cell."""
        bins = _bins_of_cells([len(c) + 1 for c in self.cuts])
        total = np.zeros(bins.shape[1])
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(x) for x in (tree.feature, tree.cut, tree.left, tree.right, tree.value))
            at = np.zeros(len(total), np.int64)
            while len(moving := np.flatnonzero(feature[at] >= 0)):
                node = at[moving]
                at[moving] = np.where(bins[feature[node], moving] <= cut[node], left[node], right[node])
            total += value[at]
        return total / len(self.trees)


def _bins_of_cells(sizes: list[int]) -> np.ndarray:
    """The range of every feature, by cell."""
    return np.stack(np.unravel_index(np.arange(int(np.prod(sizes))), sizes))


def cells_of(x: np.ndarray, features: list[int], cuts: list) -> np.ndarray:
    """The cell of every row; ``x`` has a line per variable."""
    cell = np.zeros(x.shape[1], np.int64)
    for f, c in zip(features, cuts):
        cell *= len(c) + 1
        cell += np.searchsorted(np.asarray(c), x[f])
    return cell


def visit(x: np.ndarray, missing: np.ndarray, forest: CellForest, table: np.ndarray) -> None:
    """Complete the forest's target in the rows that lack it."""
    rows = np.flatnonzero(missing[forest.target])
    x[forest.target, rows] = table[cells_of(x[:, rows], forest.features, forest.cuts)]


def grown(weight: np.ndarray, label: np.ndarray, sizes: list[int], depth: int, rng, center: float) -> Tree:
    """A tree from the sums of weights and of weighted labels (less ``center``) per cell."""
    bins, n_features = _bins_of_cells(sizes), len(sizes)
    looked_at = -(-n_features // 3)
    tree, at = Tree([], [], [], [], []), np.zeros(len(weight), np.int64)
    used = weight > 0
    bins, at, weight, label = bins[:, used], at[used], weight[used], label[used]

    def add(means) -> None:
        for m in means:
            for column, x in zip((tree.feature, tree.cut, tree.left, tree.right, tree.value), (-1, 0, 0, 0, float(m) + center)):
                column.append(x)

    add([label.sum() / weight.sum() if len(weight) else 0.0])
    front = np.array([0])
    for _ in range(depth):
        if not len(front) or not len(weight):
            break
        place = np.full(len(tree.value), -1)
        place[front] = np.arange(len(front))
        slot = place[at]
        live = slot >= 0
        slot, own = slot[live], np.flatnonzero(live)
        drawn = rng.random((len(front), n_features)).argsort(axis=1)[:, :looked_at]
        best, chosen = np.full(len(front), -np.inf), np.zeros((len(front), 2), np.int64)
        sums = np.zeros((len(front), 2, 2))
        for f in range(n_features):
            key, size = slot * sizes[f] + bins[f, own], len(front) * sizes[f]
            w, y = (np.bincount(key, v[own], size).reshape(-1, sizes[f]).cumsum(axis=1) for v in (weight, label))
            wl, yl, wr, yr = w[:, :-1], y[:, :-1], w[:, -1:] - w[:, :-1], y[:, -1:] - y[:, :-1]
            if not wl.shape[1]:
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                whole = y[:, -1:] ** 2 / w[:, -1:]
                gain = np.where((wl > 0) & (wr > 0), yl**2 / wl + yr**2 / wr - whole, -np.inf)
            gain[~(drawn == f).any(axis=1)] = -np.inf
            # Sums that differ by rounding only are no gain.
            gain[gain <= 1e-12 * np.abs(whole)] = -np.inf
            cut = gain.argmax(axis=1)
            rows = np.flatnonzero(np.take_along_axis(gain, cut[:, None], 1)[:, 0] > best)
            best[rows], chosen[rows, 0], chosen[rows, 1] = gain[rows, cut[rows]], f, cut[rows]
            sums[rows, 0] = np.stack((wl[rows, cut[rows]], yl[rows, cut[rows]]), axis=1)
            sums[rows, 1] = np.stack((wr[rows, cut[rows]], yr[rows, cut[rows]]), axis=1)
        split = np.flatnonzero(np.isfinite(best))
        first = len(tree.value)
        for i, s in enumerate(split.tolist()):
            node = int(front[s])
            tree.feature[node], tree.cut[node] = int(chosen[s, 0]), int(chosen[s, 1])
            tree.left[node], tree.right[node] = first + 2 * i, first + 2 * i + 1
        add((sums[split, :, 1] / sums[split, :, 0]).ravel())
        goes = np.isfinite(best)[slot]
        slot, own = slot[goes], own[goes]
        child = np.full(len(front), -1)
        child[split] = first + 2 * np.arange(len(split))
        at[own] = child[slot] + (bins[chosen[slot, 0], own] > chosen[slot, 1])
        front = np.arange(first, len(tree.value))
    return tree


def _poisson_counts() -> np.ndarray:
    """A Poisson count of mean one for each of 65,536 equally likely draws."""
    upto = np.cumsum(np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 12.0))))
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _draws(keys: np.ndarray, salt: int) -> np.ndarray:
    """Four draws of 16 bits a row."""
    z = keys + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype("<u8").view("<u2").reshape(-1, 4)


def _salt(*labels: int) -> int:
    return int(np.random.SeedSequence(labels).generate_state(1, np.uint64)[0])


def _flags(mask: np.ndarray, k: int) -> np.ndarray:
    return (mask >> np.arange(k, dtype=np.uint8)[:, None]) & 1 == 1


def _started(wide: DataFrame, variables, means) -> DataFrame:
    """The rows with missing values at their means, what was missing as bits of a number, and a key for draws."""
    bits = [F.when(F.col(v).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(variables)]
    key = [c for c in wide.columns if c not in variables]
    filled = {v: F.coalesce(F.col(v).cast("double"), F.lit(float(means[v]))) for v in variables}
    return wide.withColumns({_MISSING: sum(bits[1:], bits[0]), _KEY: F.xxhash64(*(key or variables))}).withColumns(filled)


def _read(batch: pa.RecordBatch, variables) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in variables])
    return x, batch.column(_MISSING).to_numpy(zero_copy_only=False).astype(np.uint8)


_PACKS = ["x", "missing", "key", "rest"]


def _pack(x: np.ndarray, missing: bytes, key: bytes, rest: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (x.tobytes(), missing, key, rest)], _PACKS)


def packed(wide: DataFrame, variables, means) -> DataFrame:
    """The rows as :func:`_started` has them, a batch of rows in one: a pass over packs costs little besides its arithmetic."""
    variables, rest = list(variables), [c for c in wide.columns if c not in variables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, missing), key = _read(batch, variables), batch.column(_KEY).to_numpy(zero_copy_only=False)
                sink, others = pa.BufferOutputStream(), batch.append_column(_NONE, pa.nulls(batch.num_rows)).select([*rest, _NONE])
                with pa.ipc.new_stream(sink, others.schema) as stream:
                    stream.write_batch(others)
                yield _pack(x, missing.tobytes(), key.tobytes(), sink.getvalue().to_pybytes())

    return _started(wide, variables, means).mapInArrow(run, ", ".join(f"{c} binary" for c in _PACKS))


def _unpacked(batches: Iterator[pa.RecordBatch], k: int, columns: list[str]) -> Iterator[tuple]:
    """Pack by pack what was packed: values with a line per variable, bits, keys and the rest, as far as they are read."""
    for batch in batches:
        for i in range(batch.num_rows):
            told = {c: batch.column(c)[i].as_buffer() for c in columns}
            yield np.frombuffer(told["x"]).reshape(k, -1), *(np.frombuffer(told[c], t) for c, t in (("missing", np.uint8), ("key", np.uint64)) if c in told), *([told["rest"]] if "rest" in told else [])


def _chunks(batches: Iterator[pa.RecordBatch], k: int, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Values, bits and, if read, keys of many packs at a time."""
    held, n = [], 0
    for part in _unpacked(batches, k, columns):
        held.append(part)
        n += part[0].shape[1]
        if n >= CHUNK:
            yield [np.concatenate(x, axis=-1) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x, axis=-1) for x in zip(*held)]


def moved(packs: DataFrame, k: int, forests: list[CellForest]) -> DataFrame:
    """The packs after visits."""
    tables = [f.table() for f in forests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, mask, key, rest in _unpacked(batches, k, _PACKS):
            x, missing = x.copy(), _flags(mask, k)
            for forest, table in zip(forests, tables):
                visit(x, missing, forest, table)
            yield _pack(x, mask.tobytes(), key.tobytes(), rest.to_pybytes())

    return packs.mapInArrow(run, packs.schema)


def _schema(wide: DataFrame, variables) -> StructType:
    return StructType([StructField(f.name, DoubleType()) if f.name in variables else f for f in wide.schema])


def rows_of(packs: DataFrame, wide: DataFrame, variables, forests: list[CellForest]) -> DataFrame:
    """The rows of packs after visits, with the columns of ``wide``."""
    variables, names, tables = list(variables), wide.columns, [f.table() for f in forests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, mask, rest in _unpacked(batches, len(variables), ["x", "missing", "rest"]):
            x, missing = x.copy(), _flags(mask, len(variables))
            for forest, table in zip(forests, tables):
                visit(x, missing, forest, table)
            others = pa.ipc.open_stream(rest).read_next_batch()
            columns = {**{c: others.column(c) for c in others.schema.names}, **{v: pa.array(line) for v, line in zip(variables, x)}}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return packs.select("x", "missing", "rest").mapInArrow(run, _schema(wide, variables))


@contextmanager
def _reading_packs(spark) -> Iterator[None]:
    """A reader and a batch hold a few packs at a time; tables of rows are read outside of this."""
    with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", PACKS), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", PACKS):
        yield


class FineCounts:
    """Counts of every variable's fine ranges, over the rows where each other variable is observed."""

    def __init__(self, wide: DataFrame, packs: DataFrame, variables, means):
        self.variables, k = list(variables), len(variables)
        observed = [F.col(v).cast("double") for v in variables]
        shares = [(i + 1) / FINE for i in range(FINE)]
        found = wide.agg(
            *[F.percentile_approx(c, shares, 4 * FINE).alias(f"q{i}") for i, c in enumerate(observed)],
            *[F.min(c).alias(f"a{i}") for i, c in enumerate(observed)],
            *[F.max(c).alias(f"b{i}") for i, c in enumerate(observed)],
        ).first()
        self.edges = [np.unique(np.append(found[f"q{i}"], np.linspace(found[f"a{i}"], found[f"b{i}"], FINE))) for i in range(k)]
        self.observed = {(f, j): np.zeros(len(self.edges[f])) for f in range(k) for j in range(k) if f != j}
        edges, pairs, lacking = self.edges, list(self.observed), {}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {key: np.zeros(len(edges[key[0]]) + 1) for key in pairs}
            for x, mask in _chunks(batches, k, ["x", "missing"]):
                missing = _flags(mask, k)
                codes = [np.searchsorted(e[:-1], v) for e, v in zip(edges, x)]
                for f, j in total:
                    own = ~missing[j]
                    total[f, j][:-1] += np.bincount(codes[f][own & ~missing[f]], minlength=len(edges[f]))
                    total[f, j][-1] += (own & missing[f]).sum()
            f, j = zip(*total)
            yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int32()), "j": pa.array(j, pa.int32()), "n": [t.tolist() for t in total.values()]})

        with _reading_packs(packs.sparkSession):
            for r in _few(packs.select("x", "missing")).mapInArrow(count, "f int, j int, n array<double>").toLocalIterator():
                n = np.array(r["n"])
                self.observed[r["f"], r["j"]] += n[:-1]
                lacking[r["f"], r["j"]] = lacking.get((r["f"], r["j"]), 0.0) + n[-1]
        self.now = {key: n.copy() for key, n in self.observed.items()}
        for (f, j), n in lacking.items():
            self.now[f, j][self.code(f, np.array([float(means[self.variables[f]])]))] += n

    def code(self, f: int, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges[f][:-1], values)

    def cuts(self, f: int, target: int) -> list[float]:
        """Upper ends of ranges of equal counts where ``target`` is observed, all but the last range's."""
        n = self.now[f, target]
        upto = np.cumsum(n)
        filled = np.flatnonzero(n)
        if len(filled) <= RANGES:
            return self.edges[f][filled[:-1]].tolist()
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, RANGES) / RANGES))
        return self.edges[f][at[at < filled[-1]]].tolist()

    def changed(self, f: int, table: np.ndarray, lacking: dict[int, np.ndarray]) -> None:
        """After a visit to ``f``: ``lacking`` counts rows per cell that lack it, where another variable is observed."""
        code = self.code(f, table)
        for j, n in lacking.items():
            self.now[f, j] = self.observed[f, j] + np.bincount(code, n, len(self.edges[f]))


def _few(packs: DataFrame) -> DataFrame:
    """As many tasks as there are cores: each hands on a table, whatever its rows."""
    return packs.coalesce(max(1, packs.sparkSession.sparkContext.defaultParallelism))


def fitted(packs: DataFrame, k: int, target: int, before: list[CellForest], fine: FineCounts, settings: tuple) -> CellForest:
    """A forest for ``target`` on the packs as the visits of ``before`` leave it; ``fine`` is brought up to date."""
    trees, depth, seed, turn, center = settings
    features = [f for f in range(k) if f != target]
    cuts = [fine.cuts(f, target) for f in features]
    sizes = [len(c) + 1 for c in cuts]
    n_cells, tables = int(np.prod(sizes)), [f.table() for f in before]
    salts = [_salt(seed, turn, target, g) for g in range(-(-trees // 4))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lacking, counts = np.zeros((trees, 2, n_cells)), np.zeros((len(features), n_cells)), _poisson_counts()
        for x, mask, key in _chunks(batches, k, ["x", "missing", "key"]):
            missing = _flags(mask, k)
            for forest, table in zip(before, tables):
                visit(x, missing, forest, table)
            cell, gone = cells_of(x, features, cuts), missing[target]
            for i, j in enumerate(features):
                lacking[i] += np.bincount(cell[gone & ~missing[j]], minlength=n_cells)
            own = cell[~gone]
            label, key = x[target, ~gone] - center, key[~gone]
            for g, salt in enumerate(salts):
                draws = counts[_draws(key, salt)]
                for tree in range(4 * g, min(4 * g + 4, trees)):
                    w = draws[:, tree % 4].astype(np.float64)
                    total[tree, 0] += np.bincount(own, w, n_cells)
                    total[tree, 1] += np.bincount(own, w * label, n_cells)
        data = [*(t.tobytes() for t in total), lacking.tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*range(trees), -1], pa.int32()), pa.array(data, pa.binary())], ["tree", "data"])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        # In one order, so that the sums do not depend on which task came first.
        total = sum(np.frombuffer(x) for x in sorted(rows["data"]))
        tree = int(rows["tree"].iloc[0])
        if tree < 0:
            return pd.DataFrame({"tree": [tree], "feature": [[]], "cut": [[]], "left": [[]], "right": [[]], "value": [total.tolist()]})
        made = grown(*total.reshape(2, -1), sizes, depth, np.random.default_rng([seed, turn, target, tree]), center)
        return pd.DataFrame({"tree": [tree], **{c: [x] for c, x in vars(made).items()}})

    kind = "tree int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"
    sums = _few(packs.select("x", "missing", "key")).mapInArrow(add, "tree int, data binary")
    made = {r["tree"]: r for r in sums.repartition(trees + 1, "tree").groupBy("tree").applyInPandas(grow, kind).collect()}
    lacking = np.array(made.pop(-1)["value"]).reshape(len(features), -1)
    forest = CellForest(target, features, cuts, [Tree(*(list(made[i][c]) for c in ("feature", "cut", "left", "right", "value"))) for i in range(trees)])
    fine.changed(target, forest.table(), dict(zip(features, lacking)))
    return forest


def fit(wide: DataFrame, variables, means, order, rounds: int, trees: int, depth: int, seed: int) -> tuple[list[list[CellForest]], DataFrame]:
    """The forests of every round in visiting order, and the table as the last round leaves it."""
    spark, variables = wide.sparkSession, list(variables)
    scratch, k = Scratch(spark), len(variables)
    bad = [v for v in variables if means[v] is None or not np.isfinite(float(means[v]))]
    if bad:
        raise ValueError(f"no observed value, or one that is not finite, in {bad}")
    packs = scratch.keep(packed(wide, variables, means))
    out: list[list[CellForest]] = []
    fine = FineCounts(wide, packs, variables, means)
    with _reading_packs(spark):
        for turn in range(rounds):
            if turn:
                after = scratch.keep(moved(packs, k, out[-1]))
                scratch.drop(packs)
                packs = after
            out.append([])
            for v in order:
                out[-1].append(fitted(packs, k, variables.index(v), out[-1], fine, (trees, depth, seed, turn, float(means[v]))))
        done = scratch.keep(rows_of(packs, wide, variables, out[-1] if out else []))
        scratch.drop(packs)
    return out, done


def completed(wide: DataFrame, variables, means, rounds: list[list[CellForest]]) -> DataFrame:
    """Rows of any table with these variables, completed by forests fitted before."""
    variables, forests, names = list(variables), [f for forests in rounds for f in forests], wide.columns
    tables = [f.table() for f in forests]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mask = _read(batch, variables)
            missing = _flags(mask, len(variables))
            for forest, table in zip(forests, tables):
                visit(x, missing, forest, table)
            lines = {v: pa.array(line) for v, line in zip(variables, x)}
            yield pa.RecordBatch.from_arrays([lines[c] if c in lines else batch.column(c) for c in names], names)

    return _started(wide, variables, means).mapInArrow(run, _schema(wide, variables))


_KIND = "round int, place int, target int, features array<int>, cuts array<array<double>>, tree int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"


def to_frame(spark, rounds: list[list[CellForest]]) -> DataFrame:
    """A row per tree."""
    rows = [
        (r, i, f.target, f.features, f.cuts, n, *(list(x) for x in vars(tree).values()))
        for r, forests in enumerate(rounds)
        for i, f in enumerate(forests)
        for n, tree in enumerate(f.trees)
    ]
    return spark.createDataFrame(rows, _KIND)


def from_frame(frame: DataFrame) -> list[list[CellForest]]:
    """Rounds × variables × trees rows, whatever the size of the data."""
    out: list[list[CellForest]] = []
    for r in sorted(frame.collect(), key=lambda r: (r["round"], r["place"], r["tree"])):
        if r["round"] == len(out):
            out.append([])
        if r["place"] == len(out[-1]):
            out[-1].append(CellForest(r["target"], list(r["features"]), [list(c) for c in r["cuts"]], []))
        out[-1][-1].trees.append(Tree(*(list(r[c]) for c in ("feature", "cut", "left", "right", "value"))))
    return out

