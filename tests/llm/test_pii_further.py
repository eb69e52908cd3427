"""Spans beyond the base kinds: how many of the planted ones are found, and how many of those found are right."""

import random

import pytest

from stationfill.llm import pii

from .conftest import DOCS, prose

KEY = "".join(chr(97 + i) for i in range(26))


def planted(seed):
    """(texts, right spans, wrong candidates) with each kind many times, in contexts of several sorts."""
    draw = random.Random(seed)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(draw.choice(KEY) for _ in range(n))
    groups = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    right = {
        "account": lambda: (draw.choice(["IBAN ", "account: ", "Konto ", ""]), groups("DE" + digits(20)) if draw.random() < 0.5 else "NL" + digits(2) + "ABNA" + digits(10)),
        "number": lambda: (draw.choice(["SSN ", "social security ", "number: ", ""]), f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}"),
        "local_phone": lambda: (draw.choice(["call ", "phone: ", "tel. ", "fax "]), f"({draw.randrange(212, 900)}) {draw.randrange(234, 900)}-{digits(4)}"),
        "secret": lambda: (draw.choice(["set ", "use ", "key "]), draw.choice(["password=", "token: ", "api_key = "]) + word(6) + digits(6)),
        "spelled_email": lambda: (draw.choice(["mail ", "write to ", ""]), f"{word(6)} (at) {word(5)} (dot) {draw.choice(['org', 'com', 'de'])}"),
        "handle": lambda: (draw.choice(["follow ", "by "]), f"@{word(5)}_{digits(2)}"),
        "person": lambda: (draw.choice(["with ", "said "]), draw.choice(["Dr. ", "Mr. ", "Frau "]) + draw.choice(pii.GIVEN_NAMES) + " " + word(6).capitalize()),
    }
    wrong = {
        "number": lambda: (draw.choice(["version ", "page ", "build "]), f"000-{draw.choice(['00', '12'])}-0000"),
        "account": lambda: (draw.choice(["section ", "release "]), "XQ" + digits(2) + " " + groups("".join(draw.choice("ABCDEFGH") for _ in range(16)))),
        "secret": lambda: (draw.choice(["figure ", "line "]), "password = " + word(9)),
        "local_phone": lambda: (draw.choice(["isbn ", "version "]), f"011 {digits(3)}-{digits(4)}"),
    }
    texts, good, bad = [], set(), set()
    for i in range(420):
        kind = list(right)[i % 7]
        before, span = right[kind]()
        text, start = prose(i, 8) + " " + before, None
        start = len(text)
        text += span + ", " + prose(i + 500, 6)
        good.add((i, kind, start, start + len(span)))
        if i % 3 == 0:
            other = list(wrong)[i // 3 % 4]
            before, span = wrong[other]()
            text += " " + before
            bad.add((i, other, len(text), len(text) + len(span)))
            text += span + " " + prose(i + 900, 4)
        texts.append((i, text))
    return texts, good, bad


@pytest.mark.parametrize("seed", [1, 2])
def test_precision_and_recall(spark, seed):
    texts, good, bad = planted(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).repartition(3)
    found = set()
    for r in pii.digests(docs).select("doc_id", "spans").collect():
        for span in filter(None, r.spans.split(",")):
            kind, start, end = span.split(":")
            if kind in pii.FURTHER:
                found.add((r.doc_id, kind, int(start), int(end)))
    for kind in sorted({g[1] for g in good}):
        own = {g for g in good if g[1] == kind}
        assert len(own & found) / len(own) >= 0.85, kind
    assert len(good & found) / len(good) >= 0.95
    assert len(good & found) / len(found) >= 0.95
    assert len(bad & found) / len(bad) <= 0.15


def test_features_move_the_score_within_one_pattern_of_votes():
    """Two groups with the same votes but another make-up: what the likelier one has carries over to the score."""
    votes = (1, 0, 0, 1, 0)
    rows = [("x", votes, (1, 9, 1, 3), 100, 0.9), ("x", votes, (1, 2, 5, 7), 100, 0.2)]
    weights = pii.classifier(rows)
    assert weights["digits:9"] > weights["digits:2"] and weights["word:3"] > weights["word:7"]
    assert pii.classifier([]) == {}


def test_gazetteers():
    import re

    has = lambda kind, text: re.search(pii._GAZETTEER[kind], text) is not None
    assert has("account", "DE89 3704 0044 0532 0130 00") and not has("account", "DE89 3704") and not has("account", "XQ89 3704 0044 0532 0130 00")
    assert has("person", "Dr. Maria Xyz") and not has("person", "Dr. Nobody")
    assert has("phone", "+49 30") and not has("phone", "+999 30") and has("email", "a@b.DE") and not has("email", "a@b.local")
    assert has("card", "6011 0000") and not has("card", "9011") and has("local_phone", "(212) 555-1234") and not has("local_phone", "(911) 555-1234")
