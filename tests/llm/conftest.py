"""Small tables with every kind of awkward row."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to a was with river stone cloud letter mountain paper window garden silver winter".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(("", "", "s", "ing")) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, near and exact copies, shared lines and passages."""
    passage, line = prose(1, 40), prose(2, 12)
    rows = [(i, prose(100 + i, 30 + i) + "\n" + (line if i % 2 else "short") + "\n" + prose(200 + i, 5), "en", f"s{i % 3}", None) for i in range(12)]
    rows += [(20, passage, "en", "s0", 5), (21, "Before that. " + passage + " And after!", "en", None, 7), (22, passage.replace(" ", "  \t"), None, "s1", None)]
    rows += [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \n\t ", "en", "s0", 4), (None, passage, "en", "s0", 3), (None, "alone and unnamed", "en", "s0", 3)]
    rows += [(40, prose(7, 4000), "en", "s2", 1), (41, prose(7, 4000) + " ending", "en", "s2", 1), (42, "x" * 30_000, "en", "s2", 1)]
    rows += [(5, rows[5][1], "en", "s2", None), (5, rows[5][1], "en", "s2", None)]
    rows += [(50, "é中😀 straße ß\r\n\x0b<|endoftext|> it's 12 3  four", "de", "s1", 2), (51, "\x00\x1f nul", "fr", "s1", 2)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def named(awkward):
    """Without null ids and repeated rows, as the plain restatements want it."""
    return awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def crowded(awkward):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = ["__ID", "__id_", "__th", "__lang", "__value", "value", "node", "h", "own", "alone", "firsts", "place", "with.dot", "fp", "root", "key", "keys", "shard", "n", "u", "v", "m", "label", "score", "kind", "start", "match", "declared", "host"]
    return awkward.withColumns({c: F.lit(f"own {c}") for c in extra})
