"""Whitening of embeddings with MLlib's distributed block matrices.

Every entry c of a vector becomes the integer x = floor(64 c) + 1,000,000. Rows are numbered
without gaps, centred by exact integer sums, n*x - S over n, and cut into blocks. The transposed
block matrix times itself is the scatter matrix, whose products are spread over as many middle
splits as the matrix has partitions and added there, so no task holds them all. Its eigenvectors
come from the driver (it is as large as the vectors are long, squared, and refused beyond
``MAX_LENGTH``). The blocks times the whitening matrix are the whitened rows, and their own
product with themselves shows how far their covariance is from the identity.

Vectors that are null or empty, or hold a null or non-finite entry, are left out; an entry whose
integer needs more than 62 bits counts as non-finite. Where lengths differ, the most frequent one
(of equals the longest) is kept. Repeated and null ids keep a row each. Directions in which the
vectors do not vary have no component, so equal vectors, and an empty table, give no rows. A
deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Factor and offset of the integers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows, and columns, of a block.
BLOCK = 1024
#: Longest vectors whose scatter matrix the driver decomposes: 32 MB of doubles.
MAX_LENGTH = 2048
_HALF = 31


@dataclass(frozen=True)
class Whitener:
    """Count and sums of the integers, eigenvalues and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def integers(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x and __row (0, 1, ... without gaps) for every usable vector; stored, so the numbers hold."""
    each = F.transform(F.col(vector).cast("array<double>"), lambda c: c * SCALE)
    fits = F.forall("__v", lambda v: F.coalesce(F.abs(v) < 2.0**62, F.lit(False)) & ~F.isnan(v))
    usable = table.select(F.col(key).cast("long").alias("key"), each.alias("__v")).where(F.size("__v") > 0).where(fits)
    longest = usable.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = F.transform("__v", lambda v: F.floor(v).cast("long") + OFFSET)
    rows = usable.where(F.size("__v") == (longest["d"] if longest else 0))
    stored = checkpointed(rows.select("key", whole.alias("x"), F.monotonically_increasing_id().alias("__at")))
    # The upper bits of an id tell the partition: one row for each, so this is small on any input.
    part = F.shiftright("__at", 33)
    counts = sorted((r["part"], r["count"]) for r in stored.groupBy(part.alias("part")).count().collect())
    first, firsts = 0, []
    for p, n in counts:
        firsts.append((p, first - (p << 33)))
        first += n
    shifts = table.sparkSession.createDataFrame(firsts, "__part long, __shift long")
    return stored.join(F.broadcast(shifts), part == F.col("__part")).select(
        "key", "x", (F.col("__at") + F.col("__shift")).alias("__row")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of every entry of ``x``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                high, low = (x >> _HALF).sum(axis=0), (x & ((1 << _HALF) - 1)).sum(axis=0)
                own = np.array([(int(h) << _HALF) + int(v) for h, v in zip(high, low)], object)
                n, total = n + len(x), own if total is None else total + own
        if n:
            parts = pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), parts, pa.array([n] * len(total), pa.int64())], ["i", "s", "n"])

    found = rows.select("x").mapInArrow(partial, "i int, s decimal(38,0), n long").groupBy("i")
    table = found.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (table[0]["n"] if table else 0), [int(r["s"]) for r in table]


def centred(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """key, __row, deviation (exact) and y, the vector x - S/n in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.array(total, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            most = max(int(x.max()), -int(x.min())) * n + max(map(abs, total))
            if most < 2**62:
                over = x * n - s.astype(np.int64)
            else:
                over = x.astype(object) * n - s
            widest = int(np.abs(over).max())
            if widest * widest * len(total) < 2**63:
                far = (over * over).sum(axis=1).tolist()
            else:
                far = [v if v < 2**63 else None for v in (over.astype(object) ** 2).sum(axis=1)]
            y = (over / n).astype(np.float64)
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("__row"), pa.array(far, pa.int64()), pa.ListArray.from_arrays(offsets, y.reshape(-1))],
                ["key", "__row", "deviation", "y"],
            )

    return rows.mapInArrow(run, "key long, __row long, deviation long, y array<double>")


def blocks(rows: DataFrame, n: int, length: int) -> BlockMatrix:
    """The vectors ``y`` at ``__row`` as a distributed matrix of n rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("__row", array_to_vector("y").alias("vector")), "vector")
    return IndexedRowMatrix(vectors.toDF("index", "vector"), n, length).toBlockMatrix(BLOCK, BLOCK)


def own_product(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, on the driver; products are added in as many places as there are partitions."""
    java = matrix._java_matrix_wrapper
    flipped = matrix.transpose()._java_matrix_wrapper
    splits = max(1, min(matrix.blocks.getNumPartitions(), -(-matrix.numRows() // matrix.rowsPerBlock)))
    # Python's multiply lacks the number of middle splits; with one split all products meet in one task.
    product = BlockMatrix(flipped.call("multiply", java._java_model, splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def fit(matrix: BlockMatrix, n: int, total: list[int], components: int = COMPONENTS) -> Whitener:
    """Eigenvectors of the covariance of centred rows; at most ``components`` of them, none without variance."""
    if len(total) > MAX_LENGTH:
        raise ValueError(f"vectors of {len(total)} entries; the driver decomposes at most {MAX_LENGTH}")
    covariance = own_product(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values > max(values[0], 0) * len(total) * 1e-14).sum())
    k = min(components, some)
    return Whitener(n, total, values[:k].copy(), vectors[:, :k].copy(), float(np.trace(covariance)))


def project(matrix: BlockMatrix, whitener: Whitener) -> BlockMatrix:
    """Whitened rows, a column for every component."""
    w = whitener.matrix
    parts = [
        ((i, j), DenseMatrix(len(part), part.shape[1], part.ravel(order="F")))
        for i in range(-(-w.shape[0] // BLOCK))
        for j in range(-(-w.shape[1] // BLOCK))
        for part in [w[i * BLOCK : (i + 1) * BLOCK, j * BLOCK : (j + 1) * BLOCK]]
    ]
    spark = matrix.blocks.context
    return matrix.multiply(BlockMatrix(spark.parallelize(parts, 1), BLOCK, BLOCK, *w.shape))


def whitened(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n, deviation, whitened (an array), explained (an array) and identity_error for every usable vector."""
    spark = table.sparkSession
    rows = integers(table, key, vector)
    n, total = sums(rows)
    empty = spark.createDataFrame([], "key long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    if not n:
        return empty
    points = centred(rows, n, total)
    matrix = blocks(points, n, len(total))
    whitener = fit(matrix, n, total, components)
    if not len(whitener.values):
        return empty
    flat = project(matrix, whitener)
    error = float(np.abs(own_product(flat) / n - np.eye(len(whitener.values))).max())
    per_block = flat.rowsPerBlock
    k = len(whitener.values)

    def unfold(block):
        (i, _), part = block
        for at, row in enumerate(part.toArray().tolist()):
            yield i * per_block + at, row

    # At most 1,024 components, so a block holds whole rows.
    found = spark.createDataFrame(flat.blocks.flatMap(unfold), "__row long, whitened array<double>", verifySchema=False)
    return points.select("key", "__row", "deviation").join(found, "__row").select(
        "key",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(float(v)) for v in whitener.explained[:k]]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def digests(table: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = whitened(table)
    each = rows.select("key", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("key").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )
