"""Personal data by weak supervision, with built-in functions only.

Four base kinds (email, ip, card, phone) are found by their patterns and checks and always stay.
One more pattern proposes spans of further kinds. For every span five labelers vote yes, no or
nothing: a strict pattern, a gazetteer, the words before it, the words after it and its shape.
Votes are counted by pattern of votes over all documents, and expectation-maximisation on these
counts estimates how reliable each labeler is for each kind and how likely each vote pattern is
right. Those likelihoods train the final classifier of spans, a logistic model over the votes and
over what no labeler looks at: length, make-up of digits and separators, and the word before,
hashed. Further kinds are kept where it says at least ``KEEP``.

What is collected are counts per pattern of votes and features; how many patterns there can be is
fixed, and thousands occur. Positions come from cutting a text at its matches: a span starts where the pieces
and matches before it end, counted in code points; the running sum goes over rows of matches.

Null and empty texts have no spans. Every row has a result, repeated rows and null ids included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import text_of

KINDS = ("email", "ip", "card", "phone")
FURTHER = ("account", "handle", "local_phone", "number", "person", "secret", "spelled_email")
#: A further span stays if the classifier gives it at least this.
KEEP = 0.5
ROUNDS, STEPS = 30, 200

# Runs are entered at their start or where the last match ended, and are never given back:
# matches are those of the plain patterns, but long runs cost linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
_HINTS = {"email": "@", "ip": ".", "phone": "+"}
_PROPOSED = {
    "secret": r"AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|secret|token|api_?key)\x20?[=:]\x20?\"?[A-Za-z0-9_/+-]{6,64}+\"?",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._])[A-Za-z0-9._]{1,40}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,40}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,10}",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z_][A-Za-z0-9_]{2,30}+(?![.@A-Za-z0-9_])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
_STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{2,12}$",
    "ip": r"^(?:[1-9][0-9]{0,2}\.)(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})$",
    "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9][0-9 .-]*$",
    "secret": r"^AKIA|[0-9]",
    "account": r"^[A-Z]{2}[0-9]{2}",
    "spelled_email": r"\(at\)|\[at\]",
    "local_phone": r"^\(?[2-9]",
    "number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "handle": r"[0-9_]",
    "person": r"\.\x20[A-Z][a-z]+\x20[A-Z]",
}
# Common given names of the corpus's languages.
GIVEN_NAMES = (
    "Alice Anna Anne Antoine Barbara Beatriz Carlos Carmen Charles Charlotte Christian Christine Claire Claudia Daniel David "
    "Diego Elena Elizabeth Emily Emma Eva Fernando Florian Francisco Franz Friedrich George Hans Heinrich Helen Henri Isabel "
    "Jack James Jan Javier Jean Jennifer John Jorge Joseph Juan Julia Karl Katharina Klaus Laura Linda Lisa Louis Lucas Luis "
    "Lukas Manuel Marc Margaret Maria Marie Mario Mark Martin Mary Matthias Max Michael Michel Miguel Monika Nicolas Nina "
    "Olivier Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rafael Richard Robert Sabine Sandra Sarah Sofia Sophie "
    "Stefan Susan Thomas Ursula Werner William Wolfgang"
).split()
# Characters of an account number after the country's code.
ACCOUNT_LENGTHS = {
    "AT": 18, "BE": 14, "CH": 19, "CZ": 22, "DE": 20, "DK": 16, "ES": 22, "FI": 16, "FR": 25, "GB": 20, "GR": 25, "HU": 26,
    "IE": 20, "IT": 25, "LU": 18, "NL": 16, "PL": 26, "PT": 23, "SE": 22, "SK": 22,
}
# Country codes of telephone numbers, by their first digits.
CALLING_CODES = (
    "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 "
    "92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 420 421"
).split()
# Generic domains and those of countries that the corpus's languages are spoken in, and their neighbours.
DOMAINS = "com org net edu gov int mil info biz io dev app ai co me tv eu de at ch fr be lu es mx ar cl pe uk ie us ca au nz it pt nl pl cz dk se no fi gr".split()
# Beginnings of issued keys, and names that stand before secrets.
SECRET_BEGINNINGS = "AKIA password passwd pwd secret token api_key apikey api-key".split()

_GAZETTEER = {
    "email": rf"(?i)\.(?:{'|'.join(DOMAINS)})$",
    "ip": r"^(?!0\.|127\.|255\.|169\.254\.|22[4-9]\.|2[3-5][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4[4-9]|5|2))",
    "phone": rf"^\+(?:{'|'.join(CALLING_CODES)})",
    "secret": rf"(?i)^(?:{'|'.join(SECRET_BEGINNINGS)})",
    "account": "^(?:" + "|".join(f"{c}(?:\\x20?[A-Z0-9]){{{n}}}" for c, n in ACCOUNT_LENGTHS.items()) + ")$",
    "spelled_email": rf"(?i)(?:{'|'.join(DOMAINS)})$",
    "local_phone": r"^\(?[2-9](?!11)[0-9]{2}\)?[\x20.-][2-9](?!11)",
    "person": rf"\x20(?:{'|'.join(GIVEN_NAMES)})(?:\x20|$)",
}
#: Kinds that a gazetteer cannot speak against: no list of names is whole.
_OPEN = ("person",)
_BEFORE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|address)[^A-Za-z]{0,3}(?:to|at|us)?\W*$",
    "ip": r"(?i)(?:ip|host|server|address|from)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|credit|pay)\w*\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile)\w*\W*$",
    "secret": r"(?i)(?:key|secret|token|credential)\w*\W*$",
    "account": r"(?i)(?:iban|account|konto)\W*$",
    "local_phone": r"(?i)(?:phone|tel|call|fax|mobile)\w*\W*$",
    "number": r"(?i)(?:ssn|social|security|number)\W*$",
}
#: Words that speak against any kind.
_AGAINST = r"(?i)(?:version|section|figure|chapter|isbn|page|line|build|release)\W*$"


def _found(kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    hint = _HINTS.get(kind)
    return F.when(F.col("text").contains(hint), found).otherwise(F.array().cast("array<string>")) if hint else found


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    doubled = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(match)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _proposed_kind(match: Column) -> Column:
    """Which of the further patterns a match of their union is one of."""
    chain = F
    for kind, pattern in _PROPOSED.items():
        # Look-arounds concern what is outside of the match.
        own = pattern
        chain = chain.when(match.rlike(f"^(?:{own})$"), F.lit(kind))
    return chain.otherwise(F.lit("secret"))


def matches(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, __row, kind, match, before, after, start): all matches; a row without kind for texts with none.

    Texts are read once; only matches and forty characters on either side go on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("__row"), text_of().alias("text"))
    patterns = PATTERNS | {"further": "|".join(f"(?:{p})" for p in _PROPOSED.values())}
    found = rows.select("*", *[_found(k, p).alias(f"__{k}") for k, p in patterns.items()])

    def pieces(kind: str, pattern: str) -> Column:
        cut = F.split(F.col("text"), pattern, -1)
        around = F.transform(cut, lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(40)).alias("end"), F.left(p, F.lit(40)).alias("begin")))
        return F.when(F.size(f"__{kind}") > 0, around)

    cut = found.select("doc_id", "__row", *[f"__{k}" for k in patterns], *[pieces(k, p).alias(f"__p_{k}") for k, p in patterns.items()])

    def spans(kind: str) -> Column:
        return F.transform(
            F.col(f"__{kind}"),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                m.alias("match"),
                F.get(F.col(f"__p_{kind}"), i)["n"].alias("gap"),
                F.get(F.col(f"__p_{kind}"), i)["end"].alias("before"),
                F.get(F.col(f"__p_{kind}"), i + 1)["begin"].alias("after"),
            ),
        )

    one = cut.select("doc_id", "__row", F.explode_outer(F.concat(*[spans(k) for k in patterns])).alias("s")).select("doc_id", "__row", "s.*")
    along = Window.partitionBy("__row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.length("match")).over(along)
    kind = F.when(F.col("kind") == "further", _proposed_kind(F.col("match"))).otherwise(F.col("kind"))
    # The long run of a row's matches is laid out by row and kind; a row's matches are as many as its text allows.
    placed = one.withColumn("end", ends)
    return placed.select("doc_id", "__row", kind.alias("kind"), "match", "before", "after", (F.col("end") - F.length("match")).alias("start"), "end")


def _lookup(table: dict[str, str], text: Column, kind: Column, no: int = -1) -> Column:
    """1 where the kind's pattern is in the text, ``no`` where it is not, 0 for kinds without one."""
    chain = F
    for k, pattern in table.items():
        chain = chain.when(kind == k, F.when(text.rlike(pattern), 1).otherwise(no))
    return chain.otherwise(0)


LABELERS = ("strict", "gazetteer", "before", "after", "shape")
#: What the classifier sees besides votes: length in eights, tenths of digits, separators, and the word before in so many classes.
FEATURES, WORDS = ("long", "digits", "separators", "word"), 16


def votes(spans: DataFrame) -> DataFrame:
    """Add a column per labeler: 1 yes, -1 no, 0 nothing; and the features the classifier looks at."""
    kind, match = F.col("kind"), F.col("match")
    digits = F.length(F.regexp_replace(match, "[^0-9]", "")) / F.greatest(F.length(match), F.lit(1))
    numeric = kind.isin("ip", "card", "phone", "local_phone", "number")
    word = F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1))
    return spans.withColumns(
        {
            "strict": _lookup(_STRICT, match, kind),
            "gazetteer": F.greatest(_lookup(_GAZETTEER, match, kind), F.when(kind.isin(*_OPEN), 0).otherwise(-1)),
            "before": F.when(F.col("before").rlike(_AGAINST), -1).otherwise(_lookup(_BEFORE, F.col("before"), kind, 0)),
            "after": F.when(F.col("after").rlike(r"^[A-Za-z0-9_@/=]"), -1).when(F.col("after").rlike(r"^(?:[\s,;:.)!?]|$)"), 1).otherwise(0),
            "shape": F.when(numeric, F.when(digits >= 0.6, 1).otherwise(-1)).when(kind.isin("secret", "account"), F.when(digits >= 0.15, 1).otherwise(-1)).otherwise(0),
            "long": F.least(F.floor(F.length(match) / 8), F.lit(5)).cast("int"),
            "digits": F.floor(digits * 10).cast("int"),
            "separators": F.least(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), F.lit(6)),
            "word": F.when(word != "", F.pmod(F.xxhash64(word), F.lit(WORDS)).cast("int")).otherwise(F.lit(WORDS)),
        }
    )


def estimate(counts: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """How likely each (kind, votes) is right, by expectation-maximisation over counted vote patterns.

    Each labeler has a rate of yes among right spans and among wrong ones for each kind; abstaining says nothing.
    """
    posterior = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(v, n) for k, v, n in counts if k == kind]
        share, yes = 0.7, [[0.8, 0.3] for _ in LABELERS]
        right: list[float] = []
        for _ in range(ROUNDS):
            right = []
            for v, _ in own:
                good, bad = math.log(share), math.log(1 - share)
                for vote, (g, b) in zip(v, yes):
                    if vote:
                        good += math.log(g if vote > 0 else 1 - g)
                        bad += math.log(b if vote > 0 else 1 - b)
                right.append(1 / (1 + math.exp(min(bad - good, 500))))
            total = sum(n for _, n in own)
            share = (sum(r * n for r, (_, n) in zip(right, own)) + 7) / (total + 10)
            for j in range(len(LABELERS)):
                # Pseudo-counts hold labelers on the side of truth they were written for.
                g = [8.0, 10.0]
                b = [3.0, 10.0]
                for r, (v, n) in zip(right, own):
                    if v[j]:
                        g[0] += r * n * (v[j] > 0)
                        g[1] += r * n
                        b[0] += (1 - r) * n * (v[j] > 0)
                        b[1] += (1 - r) * n
                yes[j] = [g[0] / g[1], b[0] / b[1]]
        posterior |= {(kind, v): r for r, (v, _) in zip(right, own)}
    return posterior


def _described(kind: str, v: tuple[int, ...], features: tuple[int, ...]) -> list[str]:
    votes = [f"{name}:{vote}" for name, vote in zip(LABELERS, v) if vote]
    return ["bias", f"kind:{kind}", *votes, *(f"{name}:{x}" for name, x in zip(FEATURES, features))]


def classifier(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int, float]]) -> dict[str, float]:
    """Weights of a logistic model trained on (kind, votes, features, count, likelihood), by damped gradient steps."""
    described = [_described(k, v, x) for k, v, x, _, _ in rows]
    names = sorted({f for x in described for f in x})
    place = {f: i for i, f in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(x) for x in described])
    column = np.array([place[f] for x in described for f in x], np.int64)
    weight = np.log1p([n for *_, n, _ in rows])
    target = np.array([p for *_, p in rows])
    weights, total = np.zeros(len(names)), weight.sum() or 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights[column], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / total
        weights -= 2.0 * (np.bincount(column, error[row], len(names)) + 1e-3 * weights)
    return dict(zip(names, weights.tolist()))


def score(weights: dict[str, float]) -> Column:
    """The classifier as a column over what ``votes`` adds."""
    total = F.lit(weights.get("bias", 0.0))
    for name in ("kind", *LABELERS, *FEATURES):
        own = {f.partition(":")[2]: w for f, w in weights.items() if f.startswith(f"{name}:")}
        if own:
            table = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
            total = total + F.coalesce(F.try_element_at(table, F.col(name).cast("string")), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def find(docs: DataFrame) -> DataFrame:
    """All spans (doc_id, __row, kind, start, end, base, score); a row without kind for texts with none."""
    found = matches(docs)
    # A match that fails its check loses its kind and not its row: the text still has a result.
    checked = found.withColumn("kind", F.when(_valid(F.col("kind"), F.col("match")), F.col("kind")))
    voted = checkpointed(votes(checked.withColumn("base", F.col("kind").isin(*KINDS))))
    counted = voted.where("kind IS NOT NULL").groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["n"]) for r in counted)
    patterns: dict[tuple[str, tuple[int, ...]], int] = {}
    for kind, v, _, n in rows:
        patterns[kind, v] = patterns.get((kind, v), 0) + n
    likely = estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    weights = classifier([(k, v, x, n, likely[k, v]) for k, v, x, n in rows])
    return voted.withColumn("score", score(weights)).select("doc_id", "__row", "kind", "start", "end", "base", "score")


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base kinds, base_sha256, spans, and how many further spans there are."""
    spans = find(docs)
    order = [*KINDS, *FURTHER]
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    text = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct(place.alias("p"), F.col("start").alias("s"), F.col("end").alias("e"), text.alias("t"), F.col("base").alias("b"))
    kept = F.when(F.col("kind").isNotNull() & (F.col("base") | (F.col("score") >= KEEP)), entry)
    # Spans of one text: as many as the text allows.
    lists = spans.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(kept)).alias("__each"))
    base = F.filter("__each", lambda x: x["b"])
    # What lies in a base span already is not added under another name.
    clear = lambda x: x["b"] | ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    lists = lists.select("doc_id", F.filter("__each", clear).alias("__all"))
    base = F.filter("__all", lambda x: x["b"])
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["t"]), ",")
    count = lambda k: F.size(F.filter("__all", lambda x: x["p"] == k)).cast("long")
    return lists.select(
        "doc_id",
        *[count(i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("__all")).alias("spans"),
        F.size(F.filter("__all", lambda x: ~x["b"])).cast("long").alias("n_further"),
    )
