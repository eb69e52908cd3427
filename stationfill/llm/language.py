"""Language identification by fusing evidence in Bayes' rule.

Four sources speak about a row's language: the likelihood of the text under byte-trigram
models, the language its markup declares, the address suffix, and where it comes from. The
likelihoods of the declared language and suffix, and the priors of hosts, are grouped counts
over all rows of what the text alone says; a host's prior is smoothed towards its domain's,
and that towards the whole corpus's.

The trigram models are fitted on a bounded sample of labelled texts: about ``per_language``
whole texts of each language, chosen by content hash. Everything else is counted over all rows.

Null and empty texts, and texts whose trigrams are mostly strange to every model, get language
"und" with confidence 0. Missing evidence (null) says nothing. Rows equal in id, text and
evidence get equal results. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import bounded_batches, keyed, rows_with, text_of

BUCKETS = 1 << 16
#: Bytes scored at a time, so that a long text costs no more memory than a short one.
_SLICE = 1 << 22
UNKNOWN = "und"

_CLASS = np.full(256, 32, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte but the last two, and whether it has letters only at its middle."""
    c = _CLASS[data]
    code = c[:-2] | c[1:-1] << 8 | c[2:] << 16
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), c[1:-1] != 32


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets per language; ``seen`` marks buckets met in fitting."""

    languages: tuple[str, ...]
    table: np.ndarray
    seen: np.ndarray


def fit_text_model(labelled: DataFrame, per_language: int = 1500) -> TextModel:
    """Count trigrams of about ``per_language`` texts for each value of ``lang`` (rows without one are left out)."""
    rows = labelled.where(F.col("lang").isNotNull() & (text_of() != "")).select("lang", text_of().alias("text"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(totals))
    if not languages:
        return TextModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(BUCKETS, bool))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in totals.items()])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    bounded_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                if len(data) > 2:
                    bucket, wordy = _trigrams(data)
                    sums[lang] = sums.get(lang, 0) + np.bincount(bucket[wordy], minlength=BUCKETS)
        for lang, n in sums.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met)), pa.array(met.astype(np.int32)), pa.array(n[met].astype(np.int64))], ["lang", "bucket", "n"]
            )

    chosen = rows.where(draw < share)
    counts = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(languages)))
    column = {k: i for i, k in enumerate(languages)}
    which = [column[k] for k in counts.column("lang").to_pylist()]
    table[counts.column("bucket").to_numpy(), which] = counts.column("n").to_numpy()
    smooth = (table + 0.5) / (table + 0.5).sum(axis=0)
    return TextModel(languages, np.log(smooth).astype(np.float32), table.sum(axis=1) > 0)


def _scores(model: TextModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text in ``data`` (cut at ``offsets``): log-likelihoods, trigrams counted, and how many were seen in fitting."""
    n = len(offsets) - 1
    sums, met, seen = np.zeros((n, len(model.languages))), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(0, max(len(data) - 2, 0), _SLICE):
        bucket, wordy = _trigrams(data[at : at + _SLICE + 2])
        first, last = np.searchsorted(offsets, [at, at + len(bucket) - 1], side="right") - 1
        cuts = np.clip(offsets[first : last + 2] - at, 0, len(bucket))
        inside = wordy.copy()
        for back in (1, 2):  # trigrams that reach into the next text
            over = offsets[first + 1 : last + 2] - at - back
            inside[over[(over >= 0) & (over < len(bucket))]] = False
        filled = np.flatnonzero(np.diff(cuts) > 0)
        starts, to = cuts[:-1][filled], first + filled
        if not len(starts):
            continue
        met[to] += np.add.reduceat(inside.astype(np.int64), starts)
        seen[to] += np.add.reduceat((inside & model.seen[bucket]).astype(np.int64), starts)
        for k in range(len(model.languages)):
            sums[to, k] += np.add.reduceat(np.where(inside, model.table[bucket, k], 0.0), starts, dtype=np.float64)
    return sums, met, seen


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """Replace ``text`` by ``loglik`` (array, a third of the sum since each byte is in three trigrams), ``met`` and ``known``."""
    bounded_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py().encode() for x in batch.column("text")]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
            sums, met, seen = _scores(model, np.frombuffer(b"".join(data), np.uint8), offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in rest),
                    pa.array((sums / 3).tolist(), pa.list_(pa.float64())),
                    pa.array(met),
                    pa.array(seen / np.maximum(met, 1)),
                ],
                [*rest, "loglik", "met", "known"],
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "loglik array<double>, met long, known double"])
    return rows.mapInArrow(run, schema)


def declared_language(html: str) -> Column:
    """The language that the html element declares, its first part in lower case."""
    found = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def host_of(url: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def suffix_of(url: str) -> Column:
    """Top-level domain and a first path part of two letters, as sites use for languages."""
    path = F.lower(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    top = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    return F.when(F.col(url).isNotNull(), F.concat_ws("/", top, path))


def _argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int")


def fuse(evidence: DataFrame, model: TextModel, strength: float = 20.0, min_known: float = 0.5) -> DataFrame:
    """Add ``lang`` and ``confidence`` to rows with loglik, met, known, declared, suffix, host and domain.

    ``strength`` is the number of rows that the level above counts as in a host's and a domain's prior.
    """
    n = len(model.languages)
    if not n:
        return evidence.withColumns({"lang": F.lit(UNKNOWN), "confidence": F.lit(0.0)})
    strange = (F.col("met") == 0) | (F.col("known") < min_known)
    clear = evidence.where(~strange).withColumn("__text", _argmax(F.col("loglik")))
    ones = lambda: [F.sum((F.col("__text") == i + 1).cast("double")).alias(f"n{i}") for i in range(n)]
    counts = clear.groupBy("declared", "suffix", "host", "domain").agg(*ones())
    counts = checkpointed(counts)
    total = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(n)]).first()
    prior = [(total[i] + 1.0) / (sum(total) + n) for i in range(n)]

    def level(by: str, above: list[Column], parent: DataFrame | None = None, via: str | None = None) -> DataFrame:
        own = counts.where(F.col(by).isNotNull()).groupBy(by, *([via] if via else [])).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
        if parent is not None:
            own = own.join(parent, via)
        all_rows = sum((F.col(f"n{i}") for i in range(n)), F.lit(0.0))
        share = F.array(*[(F.col(f"n{i}") + strength * above[i]) / (all_rows + strength) for i in range(n)])
        return own.select(by, *([via] if via else []), share.alias(f"__{by}"))

    domains = level("domain", [F.lit(p) for p in prior])
    hosts = level("host", [F.col("__domain")[i] for i in range(n)], domains, "domain").select("host", "domain", "__host")

    def witness(by: str) -> DataFrame:
        """Log-likelihood of this value under each language, one pseudo-row shared by the values."""
        own = counts.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
        values = counts.where(F.col(by).isNotNull()).agg(
            *[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(n)], F.countDistinct(by).alias("d")
        ).first()
        return own.select(
            by, F.array(*[F.log((F.col(f"n{i}") + 1.0) / F.lit(values[i] + values["d"] + 1.0)) for i in range(n)]).alias(f"__{by}")
        )

    combos = (
        evidence.select("declared", "suffix", "host", "domain").distinct()
        .join(witness("declared"), "declared", "left")
        .join(witness("suffix"), "suffix", "left")
        .join(hosts, ["host", "domain"], "left")
        .join(domains, "domain", "left")
    )
    logs = []
    for i in range(n):
        from_host = F.coalesce(F.col("__host")[i], F.col("__domain")[i], F.lit(prior[i]))
        logs.append(F.log(from_host) + F.coalesce(F.col("__declared")[i], F.lit(0.0)) + F.coalesce(F.col("__suffix")[i], F.lit(0.0)))
    combos = combos.select(*[F.coalesce(F.col(c), F.lit("\0")).alias(f"__{c}") for c in _KEYS], F.array(*logs).alias("__prior"))
    # Rows of one combination may be a third of all; adaptive execution splits or broadcasts this join.
    joined = evidence.withColumns({f"__{c}": F.coalesce(F.col(c), F.lit("\0")) for c in _KEYS}).join(
        combos, [f"__{c}" for c in _KEYS]
    )
    logp = F.zip_with("loglik", "__prior", lambda a, b: a + b)
    top = F.array_max("__logp")
    spread = F.aggregate("__logp", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("__logp")))
    names = F.array(*[F.lit(x) for x in model.languages])
    return joined.withColumn("__logp", logp).select(
        *evidence.columns,
        F.when(strange, F.lit(UNKNOWN)).otherwise(F.element_at(names, F.array_position("__logp", top).cast("int"))).alias("lang"),
        F.when(strange, F.lit(0.0)).otherwise(1.0 / spread).alias("confidence"),
    )


_KEYS = ("declared", "suffix", "host", "domain")


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence, and what the text alone, the markup and the address say, for every page."""
    body = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(body, F.lit("")).alias("text"),
        declared_language("html").alias("declared"),
        suffix_of("url").alias("suffix"),
        host_of("url").alias("host"),
        domain_of(host_of("url")).alias("domain"),
    )
    evidence = checkpointed(text_evidence(rows, model))
    own = F.element_at(F.array(*[F.lit(x) for x in model.languages] or [F.lit(UNKNOWN)]), F.greatest(_argmax(F.col("loglik")), F.lit(1)))
    return fuse(evidence, model).select(
        "page_id", "lang", F.round("confidence", 6).alias("confidence"), F.when(F.col("lang") != UNKNOWN, own).alias("text_lang"), "declared", "suffix", "host"
    )


def keep_identified(docs: DataFrame, model: TextModel, min_confidence: float = 0.5) -> DataFrame:
    """The documents with a recognised language, all columns, ``lang`` set to it.

    The declared language is ``lang``, the host is ``source``. Rejected are texts without letters,
    texts mostly strange to all models, and those whose best language is less likely than ``min_confidence``.
    Rows of one id and text share the most confident judgement among them.
    """
    rows = keyed(docs, F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.col("source").alias("domain"))
    evidence = checkpointed(text_evidence(rows.drop("doc_id"), model))
    found = fuse(evidence, model).where((F.col("lang") != UNKNOWN) & (F.col("confidence") >= min_confidence))
    best = found.groupBy("__id", "__th").agg(F.max_by("lang", F.struct("confidence", "lang")).alias("value"))
    return rows_with(docs, best, "lang")
