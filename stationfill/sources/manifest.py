"""Comparing the files that are there with the files that should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C


def file_totals(listing: DataFrame) -> DataFrame:
    """Files and bytes per year."""
    return listing.groupBy("year").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def compare_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """One row per file on either side: found, missing, size_mismatch or unexpected.

    An expected size of 0 is not checked.
    """
    expected = manifest.select("station_id", "year", F.col("size").alias("expected_size"))
    actual = listing.select("station_id", "year", F.col("size").alias("actual_size"))
    status = (
        F.when(F.col("expected_size").isNull(), "unexpected")
        .when(F.col("actual_size").isNull(), "missing")
        .when((F.col("expected_size") > 0) & (F.col("expected_size") != F.col("actual_size")), "size_mismatch")
        .otherwise("found")
    )
    return expected.join(actual, ["station_id", "year"], "full_outer").withColumn("status", status)


def audit(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files per year and status."""
    return compare_files(manifest, listing).groupBy("year", "status").agg(F.count("*").alias("n_files"))


def clean_candidates(manifest: DataFrame, listing: DataFrame, prefixes=C.NORTH_AMERICA_PREFIXES) -> DataFrame:
    """Files present with the wrong size, or outside the id prefixes (``None``: any id). Nothing is deleted."""
    compared = compare_files(manifest, listing).where(F.col("actual_size").isNotNull())
    inside = F.lit(True) if prefixes is None else F.substring("station_id", 1, 2).isin(*prefixes)
    reason = F.when(~inside, "filtered").when(F.col("status") == "size_mismatch", "corrupted")
    return (
        compared.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("station_id", "year", "reason", F.col("actual_size").alias("n_bytes"), "expected_size")
    )
