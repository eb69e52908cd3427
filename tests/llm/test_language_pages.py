"""Languages of pages: every step restated plainly, and accuracy on pages whose language is known."""

import math
import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stationfill.llm import language, op_queries

GIVEN = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables not present")


def classes(text):
    return [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]


def trigrams(text):
    """Buckets of the trigrams whose middle is a letter."""
    c = classes(text)
    return [((c[i] | c[i + 1] << 8 | c[i + 2] << 16) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(c) - 2) if c[i + 1] != 32]


def fitted(docs):
    counts = defaultdict(Counter)
    for lang, text in docs:
        if lang is not None and text:
            counts[lang].update(trigrams(text))
    names = sorted(counts)
    total = {k: sum(counts[k].values()) + 0.5 * language.BUCKETS for k in names}
    seen = set().union(*(counts[k] for k in names))
    return names, lambda k, b: math.log((counts[k][b] + 0.5) / total[k]), seen


def parts(url, html):
    found = re.search(r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", html or "")
    declared = found[1].lower() if found else None
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
    host = found[1].lower() if found else None
    top = re.search(r"\.([a-z]+)$", host or "")
    path = re.match(r"[^:]+://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", url or "")
    suffix = f"{top[1] if top else ''}/{path[1].lower() if path else ''}" if url is not None else None
    found = re.search(r"([^.]+\.[^.]+)$", host or "")
    domain = (found[1] if found else host) if host else None
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ", html or "")
    return body, declared, suffix, host, domain


def identified(pages, docs, strength=20.0):
    """page_id -> (lang, confidence), by the formulas of the module's docstrings."""
    names, logp, seen = fitted(docs)
    rows = {}
    for page_id, url, html in pages:
        body, *evidence = parts(url, html)
        grams = trigrams(body)
        likely = [sum(logp(k, b) for b in grams) / 3 for k in names]
        strange = not grams or sum(b in seen for b in grams) / len(grams) < 0.5
        rows[page_id] = (likely, strange, *evidence)
    best = {i: max(range(len(names)), key=lambda k: r[0][k]) for i, r in rows.items() if not r[1]}

    def counted(place):
        out = defaultdict(lambda: [0] * len(names))
        for i, k in best.items():
            if rows[i][place] is not None:
                out[rows[i][place]][k] += 1
        return out

    n = len(names)
    whole = [sum(k == j for k in best.values()) for j in range(n)]
    prior = [(whole[j] + 1) / (sum(whole) + n) for j in range(n)]
    smoothed = lambda own, above: [(own[j] + strength * above[j]) / (sum(own) + strength) for j in range(n)]
    domains = {d: smoothed(c, prior) for d, c in counted(5).items()}
    hosts = {h: smoothed(c, domains[next(rows[i][5] for i in best if rows[i][4] == h)]) for h, c in counted(4).items()}

    def witness(place):
        own = counted(place)
        sums = [sum(c[j] for c in own.values()) for j in range(n)]
        return {v: [math.log((c[j] + 1) / (sums[j] + len(own) + 1)) for j in range(n)] for v, c in own.items()}

    declared, suffixes = witness(2), witness(3)
    out = {}
    for i, (likely, strange, lang, suffix, host, domain) in rows.items():
        if strange:
            out[i] = ("und", 0.0)
            continue
        base = hosts.get(host) or domains.get(domain) or prior
        total = [likely[j] + math.log(base[j]) + declared.get(lang, [0] * n)[j] + suffixes.get(suffix, [0] * n)[j] for j in range(n)]
        top = max(total)
        out[i] = (names[total.index(top)], 1 / sum(math.exp(x - top) for x in total))
    return out


def given(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{GIVEN}/pages.parquet").select("page_id", "url", "html").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("lang", "text").collect()]
    return pages, docs


def test_same_as_the_plain_way(spark):
    pages, docs = given(spark)
    expected = identified(pages, docs)
    got = {r.page_id: (r.lang, r.confidence) for r in op_queries.op7_language_id(spark, GIVEN).collect()}
    assert set(got) == set(expected)
    for i, (lang, confidence) in expected.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(confidence, abs=2e-4)


def test_awkward_pages_the_plain_way(spark):
    """Declared and addressed against the text, short texts that need the host's prior, and pages with nothing."""
    pages, docs = given(spark)
    names = {lang: next(t for k, t in docs if k == lang and t and len(t) > 300) for lang in ("en", "de", "fr", "es")}
    rows = [(1000 + i, f"https://shop.site{i % 2}.de/de/{i}", f"<html lang=de><p>{names['de'][20 * i : 20 * i + 200]}</p>") for i in range(8)]
    rows += [(1100, "https://shop.site0.de/x", names["de"][40:48]), (1101, "https://other.site0.de/x", names["en"][40:52]), (1102, None, names["fr"][:200])]
    rows += [(1103, "https://a.fr/fr-FR?x", f"<html lang='en-GB'>{names['es'][:300]}"), (1104, "bad url", None), (1105, "http://u:p@h:80/", "<script>x</script>"), (1106, None, "12 34 !!"), (1107, "http://x.yz", "жжжжж ыыыыы щщщщщ")]
    every = pages + rows
    expected = identified(every, docs)
    table = spark.createDataFrame(every, "page_id long, url string, html string")
    labelled = spark.read.parquet(f"{GIVEN}/documents.parquet")
    got = {r.page_id: (r.lang, r.confidence) for r in language.identify_pages(table, language.fit_text_model(labelled)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in expected.items()}
    assert all(got[i][1] == pytest.approx(expected[i][1], abs=2e-4) for i in got)
    assert got[1103][0] == "es" and got[1105][0] == got[1106][0] == "und"


def test_accuracy_on_pages_of_known_language(spark):
    """What the markup declares is the truth here; it is hidden, and the address with it, so text and host have to tell."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = language.declared_language("html").alias("truth")
    known = pages.select("*", truth).where(F.col("truth").isNotNull())
    model = language.fit_text_model(spark.read.parquet(f"{GIVEN}/documents.parquet"))

    def accuracy(table):
        found = language.identify_pages(table, model).join(known.select("page_id", "truth"), "page_id")
        right, n = found.agg(F.count_if(F.col("lang") == F.col("truth")), F.count("*")).first()
        return right / n, n

    bare = known.withColumn("html", F.regexp_replace("html", r"(?i)(<html[^>]*?)\s+lang=[\"'][a-z-]+[\"']", "$1"))
    bare = bare.withColumn("url", F.regexp_replace("url", "(://[^/]+/)[a-z]{2}/", "$1"))
    assert bare.where(language.declared_language("html").isNotNull()).count() == 0
    with_markup, n = accuracy(known)
    without, _ = accuracy(bare)
    assert n > 150 and with_markup >= 0.95 and without >= 0.9
    # A few words of each page: there the other evidence carries more.
    opening = F.regexp_extract("html", "(?i)<html[^>]*>", 0)
    short = known.withColumn("html", F.concat(opening, F.substring(F.regexp_extract("html", "<h1>([^<]*)", 1), 1, 12)))
    alone = bare.withColumn("html", F.substring(F.regexp_extract("html", "<h1>([^<]*)", 1), 1, 12))
    assert accuracy(short)[0] > accuracy(alone)[0]
