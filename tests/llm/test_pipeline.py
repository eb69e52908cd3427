"""The pipeline: each stage on its own input by brute force, then the whole."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from stationfill.llm import op_queries

from . import brute
from .test_jaccard import kept

GIVEN = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{GIVEN}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, GIVEN).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.doc_id for r in docs.collect()]
        assert len(after) == len(set(after))
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.95 * len(before)
        if name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(brute.SPACE.sub(" ", before[i] or ""), i)
            assert set(after) == set(first.values())
        if name == "simhash_near_dedup":
            assert set(after) == kept(list(before.items()))
        if name == "benchmark_decontamination":
            assert set(after) == {i for i, x in brute.contamination(list(before.items()), items).items() if not x[4]}
        if name == "bpe_encoding":
            assert set(after) == set(before) and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_the_caller_keep_their_values(spark, crowded, name):
    """Extra columns whose names the stages use themselves come back as they were."""
    out = dict(corpus_pipeline.STAGES)[name](spark, crowded, GIVEN)
    assert out.columns == crowded.columns
    assert dict(out.dtypes) == dict(crowded.dtypes)
    rows = out.collect()
    given = {(r.doc_id, r.text) for r in crowded.collect()}
    assert rows and {(r.doc_id, r.text) for r in rows} <= given
    extra = [c for c in crowded.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == f"own {c}" for r in rows for c in extra)
    assert dict(corpus_pipeline.STAGES)[name](spark, crowded.limit(0), GIVEN).count() == 0


def test_run_and_registration(spark):
    names = contract.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(op_queries.sql_texts()) <= set(op_queries.queries())
    assert corpus_pipeline.run(spark, GIVEN).count() > 100


@pytest.mark.parametrize("name", sorted(op_queries.sql_texts()))
def test_same_as_sql(spark, name):
    import duckdb
    import pandas as pd

    from tests.test_catalog import comparable

    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{GIVEN}/{table}.parquet'")
    expected = duck.execute(op_queries.sql_texts()[name]).df()
    got = op_queries.queries()[name](spark, GIVEN).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(comparable(got), comparable(expected), check_dtype=False)


def test_training_does_not_hang_on_the_order_of_rows(spark):
    from stationfill.llm import quality

    docs, labels = (spark.read.parquet(f"{GIVEN}/{t}.parquet") for t in ("documents", "labels"))
    first = quality.train(docs, labels, max_rows=60)
    second = quality.train(docs.repartition(7), labels.orderBy(labels.doc_id.desc()), max_rows=60)
    assert first.bias == second.bias and (first.weights == second.weights).all() and (first.factors == second.factors).all()


def test_unknown_parts_get_a_placeholder(spark):
    from stationfill.llm import chat

    part = lambda kind, text=None, ref=None: (kind, text, ref, None, None, None, None)
    rows = [(1, 0, "user", [part("text", "see [ATT 1] "), part("video", None, "r1"), part(None, "x", "r2"), None, part("text", "end")])]
    made = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in made.attachments] == [(1, "video", "r1", 0), (2, None, "r2", 0), (3, None, None, 0)]
    assert chat.read_back(made.segment) == ("user", "see [ATT 1] [ATT 1][ATT 2][ATT 3]end")
    assert "see [\\ATT 1] [ATT 1]" in made.segment
