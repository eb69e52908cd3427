"""Exact duplicates by sorting content, with built-in functions only.

Texts are normalised (each run of white space is one space), range-partitioned by sampled
splitters and sorted where they land; equal texts are then neighbours, and comparing
neighbours in full finds the groups. Splitters are taken from the first characters, a digest
and a salt, so what the driver samples is small and no text, however often it occurs, has to
fit one partition. The parts that a group has in several salts are brought together by one small
row each, by beginning, SHA-256 and length: whole texts are shuffled once.

Null text is empty. A null id comes after every other id. Of rows equal in id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import NO_ID, rows_of, text_of

#: Parts that one text's rows are dealt to before they meet.
SALTS = 16
_HEAD = 32


def normalised(name: str = "text"):
    # Single spaces need no replacement, so only other runs are matched.
    return F.regexp_replace(text_of(name), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def duplicate_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, __id, __th, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text_of()).alias("__th"),
        normalised().alias("__norm"),
    ).select(
        "doc_id",
        "__th",
        "__norm",
        F.left("__norm", F.lit(_HEAD)).alias("__head"),
        F.unhex(F.sha2("__norm", 256)).alias("__digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("__salt"),
    )
    text = ["__head", "__digest", "__norm"]
    neighbours = Window.partitionBy(*text, "__salt")
    by_id = [F.col("doc_id").asc_nulls_last(), "__th"]
    # Without the texts these rows are small; they are read twice below, so they are stored.
    found = rows.repartitionByRange("__head", "__digest", "__salt").select(
        "__head",
        "__digest",
        F.length("__norm").alias("__long"),
        "__salt",
        "doc_id",
        "__th",
        F.row_number().over(neighbours.orderBy(*by_id)).alias("__place"),
        F.first("doc_id").over(neighbours.orderBy(*by_id)).alias("__first"),
        F.count(F.lit(1)).over(neighbours).alias("__n"),
    )
    local = checkpointed(found)
    firsts = local.where("__place = 1")
    same = Window.partitionBy("__head", "__digest", "__long")
    across = same.orderBy(F.col("__first").asc_nulls_last(), "__salt")
    groups = firsts.select(
        F.col("__digest"),
        F.col("__salt"),
        F.coalesce("__first", F.lit(NO_ID)).alias("__first"),
        F.first("__first").over(across).alias("keep_id"),
        F.sum("__n").over(same).alias("group_size"),
        (F.row_number().over(across) == 1).alias("__best"),
    )
    members = local.select(
        "__digest", "__salt", F.coalesce("__first", F.lit(NO_ID)).alias("__first"), "doc_id", "__th", "__place"
    )
    return members.join(groups, ["__digest", "__salt", "__first"]).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"),
        "__th",
        "keep_id",
        "group_size",
        (F.col("__best") & (F.col("__place") == 1)).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    return rows_of(docs, duplicate_groups(docs).where("kept"))
