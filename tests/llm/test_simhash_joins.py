"""Tables that explode makes 66 or 1,089 times larger are not sent to every task through the driver."""

import random

import pytest

from stationfill.llm import jaccard, simhash


@pytest.mark.parametrize("crowd", [64, 0])
def test_exploded_tables_are_not_broadcast(spark, crowd):
    draw = random.Random(5)
    first = [draw.getrandbits(64) - (1 << 63) for _ in range(60)]
    values = {x ^ y for x in first for y in (0, 1 << 5, 1 << 40, (1 << 3) | (1 << 50), 7)}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long").distinct(), crowd)
    found = {(r.u, r.v) for r in edges.collect()}
    assert found == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    joins = [x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "Inner" in x]
    assert joins and not [x for x in joins if "SortMergeJoin" not in x]


def test_candidates_of_the_pipeline_are_not_broadcast(spark):
    """The near-duplicate stage looks its fingerprints up in the same tables."""
    draw = random.Random(6)
    prints = [draw.getrandbits(64) - (1 << 63) for _ in range(50)]
    prints += [x ^ 1 for x in prints] + prints[:5]
    texts = spark.createDataFrame([(bytes([i]) * 16, fp) for i, fp in enumerate(prints)], "node binary, fp long")
    pairs = jaccard.simhash_candidates(texts)
    assert len(pairs.collect()) == 55
    probed = [x for x in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "bit_count" in x]
    assert probed and not [x for x in probed if "SortMergeJoin" not in x]
