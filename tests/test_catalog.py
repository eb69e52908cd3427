"""Registered queries against DuckDB on the smallest given tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from stationfill.catalog import queries, sql_texts

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries(), sql_texts()
# One per family, for a quick look with STATIONFILL_SHORT=1; otherwise every query is compared.
SHORT = (
    "blank_erroneous_values station_metadata incremental_metadata duplicates_prefer_longer enrich_from_inventory spatial_split hourly_grid "
    "gap_statistics mask_mnar linear_fill akima_fill chained_least_squares evaluate_linear wilcoxon_signed_rank extreme_spells"
).split()
CHOSEN = SHORT if os.environ.get("STATIONFILL_SHORT") else sorted(SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = [None if pd.isna(x) else (round(float(x), 6) + 0.0 if isinstance(x, float) else str(x)) for x in df[c]]
    return df.sort_values(list(df.columns), key=lambda x: x.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    expected = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(comparable(got), comparable(expected), check_dtype=False)


def test_only_iterative_fits_lack_sql():
    assert set(QUERIES) - set(SQL) == {
        "cluster_stations",
        "chained_bayesian_ridge",
        "chained_posterior_imputations",
        "chained_mean_of_imputations",
        "chained_coefficients",
        "chained_random_forest",
        "evaluate_chained",
        "evaluate_posterior_imputations",
        "paired_tests_with_p_values",
    }
    assert set(SQL) <= set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
