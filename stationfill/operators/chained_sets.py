"""Chained equations where nearly every row lacks another set of variables.

A table has one row per set that occurs: its moments, and the map that completes rows with that set
by now. Tasks work on all sets of a batch at once. For every regression a task adds up the cross
products of its sets and hands on one matrix; after each round the maps are brought up to date and
stored. Rows are completed in place: a batch works out the maps of the sets in it. So neither the
driver nor a join ever holds a map per set.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import DRAW_RANGE
from ..session import checkpointed

#: Sets that a task works on at a time.
BATCH = 4096


def start_maps(missing: np.ndarray) -> np.ndarray:
    """Maps of [1, observed…] to the completed row for sets given as rows of flags; missing ones start at 0."""
    n, k = missing.shape
    maps = np.zeros((n, k, k + 1))
    maps[:, np.arange(k), np.arange(k) + 1] = ~missing
    return maps


def apply_step(maps: np.ndarray, missing: np.ndarray, step: tuple) -> None:
    """One regression's visit, in all sets that lack its target."""
    _, target, intercept, slopes, *_ = step
    chosen = np.flatnonzero(missing[:, target])
    if len(chosen):
        others = [i for i in range(maps.shape[1]) if i != target]
        rows = np.einsum("o,sok->sk", np.asarray(slopes), maps[chosen][:, others])
        rows[:, 0] += intercept
        maps[chosen, target] = rows


def noise_roots(missing: np.ndarray, steps: list[tuple]) -> np.ndarray:
    """For every set a matrix that turns independent normals into the residuals at the end of the chain."""
    n, k = missing.shape
    carried = np.zeros((n, k, len(steps)))
    for j, (_, target, _, slopes, noise, *_) in enumerate(steps):
        chosen = np.flatnonzero(missing[:, target])
        if len(chosen):
            others = [i for i in range(k) if i != target]
            carried[chosen, target] = np.einsum("o,sok->sk", np.asarray(slopes), carried[chosen][:, others])
            carried[chosen, target, j] = noise**0.5
    values, vectors = np.linalg.eigh(carried @ carried.transpose(0, 2, 1))
    return vectors * np.sqrt(np.clip(values, 0.0, None))[:, None, :] @ vectors.transpose(0, 2, 1)


def _flags(names: pa.Array) -> np.ndarray:
    return np.array([[c == "1" for c in x] for x in names.to_pylist()], bool)


def _binary(arrays: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


class SpreadTotals:
    """Cross products over all rows where a variable is observed, added up by tasks."""

    def __init__(self, moments: DataFrame, k: int):
        self.k, self.round = k, []
        columns = ["n", *[f"s_{i}" for i in range(k)], *[f"p_{i}_{j}" for i in range(k) for j in range(i, k)]]
        places = [(0, 0), *[(0, i + 1) for i in range(k)], *[(i + 1, j + 1) for i in range(k) for j in range(i, k)]]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams = np.zeros((batch.num_rows, k + 1, k + 1))
                for c, (i, j) in zip(columns, places):
                    grams[:, i, j] = grams[:, j, i] = batch.column(c).to_numpy(zero_copy_only=False)
                names = batch.column("missing_set")
                maps = start_maps(_flags(names)) if batch.num_rows else np.zeros((0, k, k + 1))
                yield pa.RecordBatch.from_arrays([names, _binary(grams), _binary(maps)], ["missing_set", "gram", "map"])

        self.state = checkpointed(moments.select("missing_set", *columns).mapInArrow(pack, "missing_set string, gram binary, map binary"))

    def of(self, target: int) -> np.ndarray:
        steps, k, read = list(self.round), self.k, _Reader(self.k)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k + 1))
            for batch in batches:
                for part in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                    missing, grams, maps = read(part)
                    own = ~missing[:, target]
                    missing, grams, maps = missing[own], grams[own], maps[own]
                    for step in steps:
                        apply_step(maps, missing, step)
                    full = np.concatenate((np.broadcast_to(np.eye(1, k + 1), (len(maps), 1, k + 1)), maps), axis=1)
                    total += np.einsum("sab,sbc,sdc->ad", full, grams, full, optimize=True)
            yield pa.RecordBatch.from_arrays([_binary(total[None])], ["total"])

        parts = self.state.mapInArrow(add, "total binary").toLocalIterator()
        return sum(np.frombuffer(r["total"]).reshape(k + 1, k + 1) for r in parts)

    def visited(self, step: tuple) -> None:
        self.round.append(step)

    def end_round(self) -> None:
        steps, read = list(self.round), _Reader(self.k)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH)):
                    missing, _, maps = read(part)
                    for step in steps:
                        apply_step(maps, missing, step)
                    yield pa.RecordBatch.from_arrays([part.column("missing_set"), part.column("gram"), _binary(maps)], ["missing_set", "gram", "map"])

        self.state, self.round = checkpointed(self.state.mapInArrow(move, "missing_set string, gram binary, map binary")), []


class _Reader:
    """Sets, moments and maps of a batch, as arrays that may be changed."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.k
        grams = np.stack([np.frombuffer(x.as_buffer()).reshape(k + 1, k + 1) for x in batch.column("gram")])
        maps = np.stack([np.frombuffer(x.as_buffer()).reshape(k, k + 1) for x in batch.column("map")])
        return _flags(batch.column("missing_set")), grams, maps.copy()


def _standardised_batch(batch: pa.RecordBatch, model) -> tuple[np.ndarray, np.ndarray]:
    """Values (NaN where missing) and [1, standardised values with 0 where missing] of a batch's rows."""
    values = np.column_stack([batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in model.variables])
    missing = np.column_stack([batch.column(v).is_null().to_numpy(zero_copy_only=False) for v in model.variables])
    centre, spread = (np.array([float(x[v]) for v in model.variables]) for x in (model.centers, model.spreads))
    z = np.where(missing, 0.0, (np.where(missing, 0.0, values) - centre) / spread)
    return np.where(missing, np.nan, values), np.column_stack((np.ones(len(z)), z))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, BATCH) for i in range(0, batch.num_rows, BATCH))


def _normals(seed, station: list, t: list, imputations: int, names: list[str], missing: np.ndarray) -> np.ndarray:
    """The draws of ``functions.draws.standard_normal`` per row, imputation and variable; 0 where nothing is missing.

    A residual is needed in missing cells only, and its draw depends on its labels alone, so no other is drawn.
    """
    n, k = missing.shape
    out = np.zeros((n, imputations, k))
    rows, cells = np.nonzero(missing)
    if not len(rows):
        return out
    ends = [[f"|{name}|{kind}".encode() for kind in ("radius", "angle")] for name in names]
    # A NULL label is left out of the text, as concat_ws does.
    middle = ["".join(f"|{x}" for x in pair if x is not None).encode() for pair in zip(station, t)]
    each = [(middle[r], ends[c]) for r, c in zip(rows.tolist(), cells.tolist())]
    for m in range(imputations):
        front = f"{seed}|{m}".encode()
        bits = b"".join([md5(front + at + end).digest()[:4] for at, pair in each for end in pair])
        first, second = np.frombuffer(bits, ">u4").astype(np.float64).reshape(-1, 2).T
        out[rows, m, cells] = np.sqrt(-2.0 * np.log((first + 1) / DRAW_RANGE)) * np.cos(second / DRAW_RANGE * 6.283185307179586)
    return out


class _Completer:
    """All imputations of a batch's rows; the maps of a set of missing variables are worked out once a task, up to a limit."""

    def __init__(self, model, drawn: list[list[tuple]], seed):
        self.model, self.drawn, self.seed, self.known = model, drawn, seed, {}

    def _maps(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maps and roots of the noise: sets × imputations × …"""
        names = [s.tobytes() for s in sets]
        fresh = [i for i, name in enumerate(names) if name not in self.known]
        if fresh:
            if len(self.known) > BATCH:
                self.known, fresh = {}, list(range(len(names)))
            maps = np.stack([_replayed(sets[fresh], steps) for steps in self.drawn], axis=1)
            roots = np.stack([noise_roots(sets[fresh], steps) for steps in self.drawn], axis=1) if self.seed is not None else maps
            self.known.update((names[i], (m, r)) for i, m, r in zip(fresh, maps, roots))
        maps, roots = zip(*(self.known[name] for name in names))
        return np.stack(maps), np.stack(roots)

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        """Rows × imputations × variables."""
        model, variables = self.model, list(self.model.variables)
        values, x = _standardised_batch(part, model)
        missing = np.column_stack([part.column(v).is_null().to_numpy(zero_copy_only=False) for v in variables])
        sets, which = np.unique(missing, axis=0, return_inverse=True)
        which = which.ravel()
        maps, roots = self._maps(sets)
        done = np.empty((len(x), len(self.drawn), len(variables)))
        if self.seed is not None:
            z = _normals(self.seed, *(part.column(c).to_pylist() for c in ("__station", "__t")), len(self.drawn), variables, missing)
        for s in range(len(sets)):
            rows = np.flatnonzero(which == s)
            done[rows] = np.einsum("mik,rk->rmi", maps[s], x[rows])
            if self.seed is not None:
                done[rows] += np.einsum("mij,rmj->rmi", roots[s], z[rows])
        centre, spread = (np.array([float(c[v]) for v in variables]) for c in (model.centers, model.spreads))
        return np.where(missing[:, None], done * spread + centre, values[:, None])


def _replayed(sets: np.ndarray, steps: list[tuple]) -> np.ndarray:
    maps = start_maps(sets)
    for step in steps:
        apply_step(maps, sets, step)
    return maps


def _complete(wide: DataFrame, model, drawn: list[list[tuple]], seed, kind: str, lay) -> DataFrame:
    """Rows through a :class:`_Completer`; ``lay(rest, done)`` makes the columns of a batch from what it gives."""
    variables, kinds = list(model.variables), dict(wide.dtypes)
    rest = [c for c in wide.columns if c not in variables]
    labels = [F.col(c).cast("string").alias(n) for c, n in (("station_id", "__station"), ("t", "__t"))] if seed is not None else []
    more = ["imputation int"] if kind == "double" else []
    names = [*rest, *(["imputation"] if more else []), *variables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        complete = _Completer(model, drawn, seed)
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays(lay([part.column(c) for c in rest], complete(part)), names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), *more, *(f"`{v}` {kind}" for v in variables)])
    return wide.select(*rest, *variables, *labels).mapInArrow(run, schema)


def samples(wide: DataFrame, model, drawn: list[list[tuple]], seed) -> DataFrame:
    """``chained.impute_samples``: every variable an array with one value per entry of ``drawn``."""
    each = len(drawn)

    def lay(rest, done):
        ends = np.arange(0, len(done) * each + 1, each, dtype=np.int32)
        return [*rest, *(pa.ListArray.from_arrays(ends, np.ascontiguousarray(done[:, :, i]).ravel()) for i in range(done.shape[2]))]

    return _complete(wide, model, drawn, seed, "array<double>", lay)


def completed(wide: DataFrame, model, drawn: list[list[tuple]], seed) -> DataFrame:
    """``chained.impute_chained``: a row per imputation, those of one row side by side."""
    each = len(drawn)

    def lay(rest, done):
        rows = pa.array(np.repeat(np.arange(len(done)), each))
        imputation = pa.array(np.tile(np.arange(each, dtype=np.int32), len(done)))
        return [*(c.take(rows) for c in rest), imputation, *(pa.array(np.ascontiguousarray(done[:, :, i]).ravel()) for i in range(done.shape[2]))]

    return _complete(wide, model, drawn, seed, "double", lay)


def round_changes(wide: DataFrame, model, rounds: int) -> list[float | None]:
    """The largest change of a row in every round; the change of a row is the sum over its cells."""
    variables = list(model.variables)
    spread = np.array([float(model.spreads[v]) for v in variables])
    by_round = [[step for step in model.steps if step[0] == r] for r in range(rounds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(rounds)
        for batch in batches:
            for part in _parts(batch):
                _, x = _standardised_batch(part, model)
                missing = np.column_stack([part.column(v).is_null().to_numpy(zero_copy_only=False) for v in variables])
                sets, which = np.unique(missing, axis=0, return_inverse=True)
                maps, which = start_maps(sets), which.ravel()
                for r, steps in enumerate(by_round):
                    before = maps.copy()
                    for step in steps:
                        apply_step(maps, sets, step)
                    moved = np.abs(np.einsum("rik,rk->ri", (maps - before)[which], x)) * spread
                    most[r] = max(most[r], moved.sum(axis=1).max())
        yield pa.RecordBatch.from_arrays([pa.array([most.tolist()], pa.list_(pa.float64()))], ["most"])

    found = wide.select(*variables).mapInArrow(run, "most array<double>")
    return list(found.agg(*[F.max(F.get("most", F.lit(r))) for r in range(rounds)]).first())
