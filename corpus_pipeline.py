"""From raw documents to tokens: language, exact and near duplicates, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of documents; the last returns token digests. ``run`` writes every stage's result as
Parquet in the shared folder and reads it again, so a later stage never recomputes an earlier one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stationfill.llm import bpe, contamination, exact, jaccard, language
from stationfill.llm.common import read
from stationfill.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, ``lang`` set to it."""
    return language.keep_identified(docs, language.fit_text_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact.without_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents similar at 0.8 or more in five-word shingles, the one with the smallest id."""
    return jaccard.one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not made up of benchmark passages."""
    return contamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Trained models, component search and encoding have no SQL; tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
