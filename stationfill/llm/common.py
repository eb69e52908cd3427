"""Small pieces that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space in the sense of every rule here: space and the controls from tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]"
#: Stands for a missing id in join keys only; results keep the null.
NO_ID = -(2**63)
#: Text bytes of one Arrow batch, so that a task's Python side stays small whatever the row count.
BATCH_BYTES = 16 << 20
#: Rows that a Parquet reader holds at a time where whole texts are read.
READ_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Arrow batches bounded by bytes: long texts must not meet by the thousand in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bounded_reads(spark: SparkSession) -> None:
    """Fewer rows in a reader's vectors: with long texts they are a task's largest arrays, and the heap grows by them."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def release_memory() -> None:
    """Give a Python worker's memory of the last group back to the system; workers are kept for many groups."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file, where the package that brings it has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Id, text and the key of a row: id and content hash. Rows equal in both share every result."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"),
        F.xxhash64(text_of()).alias("__th"),
        text_of().alias("text"),
        *more,
    )


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until the table has no column of that name in any spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def _matched(docs: DataFrame, chosen: DataFrame, how: str, *more: str) -> tuple[DataFrame, list[str]]:
    """Columns of ``docs`` and the key of a row, joined with the keys of ``chosen`` (__id, __th)."""
    names = spare_names(docs, "__id", "__th")
    keys = dict(zip(names, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text_of()))))
    return docs.withColumns(keys).join(chosen.select("__id", "__th", *more).toDF(*names, *more), names, how), names


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``chosen`` (columns __id, __th), all columns, one row per key."""
    rows, names = _matched(docs, chosen, "left_semi")
    return rows.dropDuplicates(names).select(*own_columns(docs))


def rows_without(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``chosen`` (columns __id, __th), all columns."""
    rows, _ = _matched(docs, chosen, "left_anti")
    return rows.select(*own_columns(docs))


def rows_with(docs: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose key is in ``chosen`` (__id, __th, value), all columns, ``column`` replaced by the value."""
    value = spare_names(docs, "__id", "__th", "__value")[2]
    found, _ = _matched(docs, chosen.withColumnRenamed("value", value), "inner", value)
    return found.select(*[F.col(value).alias(c) if c == column else x for c, x in zip(docs.columns, own_columns(docs))])
