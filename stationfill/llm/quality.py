"""A quality score from a factorisation machine.

Inputs are hashed words of the whole text (dampened counts of unit length), structure statistics
of the text and the length that the metadata gives. The score adds a weight per input and, for
every pair of inputs, the product of their low-rank factors; the sum over pairs is taken in linear
time as half of (square of the sum minus sum of the squares), factor by factor.

Weights are learned in one task from at most ``max_rows`` labelled rows chosen by id hash, by
stochastic gradient steps on the logistic loss; a row comes there with one value per bucket, so that
its size is bounded whatever its text's. The model (a few hundred kilobytes, fixed by ``BUCKETS`` and
``RANK``) goes to every task. Scoring is row by row, nothing is shuffled; a task holds the inputs of
``CHUNK`` words at a time (or of one row), not those of an Arrow batch.

Null and empty texts have no words and are scored from the other inputs; a null length is the
text's own. Conflicting labels of one id count as the larger one. Without labelled rows of both
kinds the score is the share of label 1 (a half if there are none). Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_reads, text_of

BUCKETS, RANK = 1 << 12, 8
#: Labelled rows that are learned from, at most.
MAX_ROWS = 12_000
EPOCHS, BATCH, RATE, SHRINK = 6, 128, 0.02, 1e-5
THRESHOLD = 0.3
#: Inputs that are described or scored at once; results do not depend on it.
CHUNK = 1 << 16
#: Text bytes of one Arrow batch here: its inputs take a multiple of it.
TEXT_BYTES = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?'\""]] = True
_OTHER = ~(_LETTER | _DIGIT | _BLANK | _STOP)

STATISTICS = 18


def inputs(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and the statistics of a text."""
    data = text.encode()
    words = data.lower().split()
    counts = Counter(words)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = max(len(data), 1), max(len(words), 1)
    bucket = np.array([zlib.crc32(w) % BUCKETS for w in counts], np.int64)
    value = np.log1p(np.array(list(counts.values()), np.float64))
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    length = sum(len(w) * c for w, c in counts.items()) / n
    spread = sum(len(w) ** 2 * c for w, c in counts.items()) / n - length**2
    most = [c for _, c in counts.most_common(3)]
    lines = int(seen[10]) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    marked = sum(c for w, c in counts.items() if _OTHER[w[-1]]) / n
    alone = sum(c for w, c in counts.items() if len(w) == 1 and _OTHER[w[0]]) / n
    statistics = np.array(
        [
            np.log1p(len(words)) / 5, np.log1p(len(text) if n_chars is None else max(n_chars, 0)) / 8, np.log1p(lines) / 4,
            length / 8, np.sqrt(max(spread, 0.0)) / 5, len(counts) / n, (most[0] if most else 0) / n, sum(most) / n,
            seen[_LETTER].sum() / size, seen[_UPPER].sum() / size * 5, seen[_DIGIT].sum() / size * 5, seen[_BLANK].sum() / size * 3,
            seen[_STOP].sum() / size * 10, seen[_OTHER].sum() / size * 5, repeats, marked, alone * 2, np.log1p(size / lines) / 6,
        ]
    )
    return bucket, value, np.clip(statistics, 0.0, 3.0)


def merged(bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One value per bucket: the sum of its words' values, as the fit takes it."""
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    return used, np.bincount(bucket, value, BUCKETS)[used]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """The inputs of a batch's texts, in order: where each chunk begins, and its rows (the last row passes CHUNK)."""
    rows, size, begin = [], 0, 0
    for at, (text, n_chars) in enumerate(zip(batch.column("text"), batch.column("n_chars").to_pylist())):
        rows.append(inputs(text.as_py(), n_chars))
        size += len(rows[-1][0]) + STATISTICS
        if size >= CHUNK:
            yield begin, rows
            rows, size, begin = [], 0, at + 1
    if rows:
        yield begin, rows


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list per array, without Python objects for the entries."""
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _slices(lists: pa.ListArray) -> list[np.ndarray]:
    """An array per list, all of them views of the batch."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


@dataclass(frozen=True)
class Machine:
    """Bias, a weight and RANK factors per input: hashed words first, then statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1, each in time linear in the row's inputs."""
        sizes = np.array([len(b) + STATISTICS for b, _, _ in rows])
        which = np.concatenate([np.concatenate((b, BUCKETS + np.arange(STATISTICS))) for b, _, _ in rows])
        value = np.concatenate([np.concatenate((v, s)) for _, v, s in rows])
        starts = np.cumsum(sizes) - sizes
        linear = np.add.reduceat(self.weights[which] * value, starts)
        parts = self.factors[which] * value[:, None]
        pairs = (np.add.reduceat(parts, starts) ** 2 - np.add.reduceat(parts**2, starts)).sum(axis=1) / 2
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs, -50, 50)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adam on the logistic loss, in mini-batches."""
    width = BUCKETS + STATISTICS
    draw = np.random.default_rng(seed)
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Machine(float(np.log(share / (1 - share))), np.zeros(width), np.zeros((width, RANK)))
    values = [np.array([np.log(share / (1 - share))]), np.zeros(width), draw.normal(0, 0.05, (width, RANK))]
    first, second, step = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at : at + BATCH]
            x = np.zeros((len(chosen), width))
            for i, r in enumerate(chosen):
                np.add.at(x[i], rows[r][0], rows[r][1])
                x[i, BUCKETS:] = rows[r][2]
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            w, v = values[1][used], values[2][used]
            summed = x @ v
            pairs = (summed**2 - (x**2) @ (v**2)).sum(axis=1) / 2
            p = 1 / (1 + np.exp(-np.clip(values[0][0] + x @ w + pairs, -50, 50)))
            error = (p - labels[chosen]) / len(chosen)
            slopes = [
                np.array([error.sum()]),
                x.T @ error + SHRINK * w,
                x.T @ (error[:, None] * summed) - v * ((x**2).T @ error)[:, None] + SHRINK * v,
            ]
            step += 1
            for k, slope in enumerate(slopes):
                to = slice(None) if k == 0 else used
                first[k][to] = 0.9 * first[k][to] + 0.1 * slope
                second[k][to] = 0.999 * second[k][to] + 0.001 * slope**2
                values[k][to] -= RATE * (first[k][to] / (1 - 0.9**step)) / (np.sqrt(second[k][to] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(values[0][0]), values[1], values[2])


def held_out(name: str = "doc_id"):
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _length(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long").alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """Learn from labelled rows outside the held-out fold."""
    bounded_batches(docs.sparkSession, TEXT_BYTES)
    bounded_reads(docs.sparkSession)
    marked = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
    )
    share = min(1.0, max_rows / max(marked.count(), 1))
    # The fraction keeps the sample near its bound whatever the table's size; the lowest hashes of it are the
    # sample, so that it does not hang on the order of rows.
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    chosen = marked.where(draw < math.ceil(share * 1_100_000)).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, rows in chunks(batch):
                own = batch.slice(begin, len(rows))
                buckets, values = zip(*(merged(b, v) for b, v, _ in rows))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("doc_id", "th", "label")), _lists(buckets, pa.int32()), _lists(values, pa.float64()), _lists([s for _, _, s in rows], pa.float64())],
                    ["doc_id", "th", "label", "bucket", "value", "statistics"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = [], []
        for batch in batches:
            rows.extend(zip(*(_slices(batch.column(c)) for c in ("bucket", "value", "statistics"))))
            keys.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th", "label")])
        ids, hashes, marks = (np.concatenate(x) for x in zip(*keys)) if keys else [np.zeros(0, np.int64)] * 3
        # One order whatever the partitioning: the fit's steps are taken in it.
        order = np.lexsort((hashes, ids))
        made = fit([rows[i] for i in order], marks[order].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([made.bias]), pa.array([made.weights.tobytes()]), pa.array([made.factors.tobytes()])], ["bias", "weights", "factors"])

    # The sample's ids and labels, at most max_rows small rows, are sent to the documents.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"), _length(docs))
    own = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "th", "text", "n_chars", "label")
    described = own.mapInArrow(describe, "doc_id long, th long, label int, bucket array<int>, value array<double>, statistics array<double>")
    model = described.repartition(1).mapInArrow(learn, "bias double, weights binary, factors binary").first()
    return Machine(model["bias"], np.frombuffer(model["weights"]), np.frombuffer(model["factors"]).reshape(-1, RANK))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    bounded_batches(docs.sparkSession, TEXT_BYTES)
    bounded_reads(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(own.scores(rows) for _, rows in chunks(batch))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"), _length(docs))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
