"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, exact, language, lines, pii, quality, search, simhash, substrings, warc, whitening
from .common import read


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.duplicate_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_benchmark_decontamination, which its SQL fixes, and the items that proximity search finds."""
    return contamination.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"))


def op6_line_dedup_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result from a store that has been changed: all pages are inserted as documents, and deleted again."""
    docs = read(spark, sf_dir, "documents")
    pages = read(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text"))
    store = lines.store_of(docs.select("doc_id", "text")).insert(pages).delete(pages.select("doc_id"))
    return lines.digests(docs, store)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text_model(read(spark, sf_dir, "documents"))
    return language.identify_pages(read(spark, sf_dir, "pages"), model)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted(chat.text_messages(table)))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(read(spark, sf_dir, "pages"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digests(read(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

# One anchor for each place of a window in an item; documents are searched for windows as word sequences.
OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS n,
         array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i FROM bw WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS i, words FROM dw, sizes WHERE len(words) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, w.item_id
  FROM (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM pos) p JOIN win w USING (n, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), f AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL AND l.doc_id <> f.last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL OR l.doc_id = f.last), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY l.doc_id
"""


# Base 32 takes five bits at a time: eight digits from every ten hexadecimal ones.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, {10 * part + 1}, 10))::BIGINT >> {35 - 5 * digit}) & 31 AS INT), 1)"
    for part in range(4)
    for digit in range(8)
)
OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS data, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY data) AS first FROM p)
SELECT page_id, CAST(strlen(data) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


OP12_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS doc, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark)
  GROUP BY item_id, term
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_words FROM dw WHERE len(words) > 0
), norm AS (
  SELECT doc, doc_id, CAST(100 - 75 + ((75 * len(words) * n_docs) // n_words) AS BIGINT) AS m FROM dw, whole WHERE len(words) > 0
), tf AS (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(words) AS term FROM dw) WHERE term IN (SELECT term FROM q) GROUP BY doc, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole
), scored AS (
  SELECT item_id, doc, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (doc) GROUP BY item_id, doc
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, CAST(score AS BIGINT) AS score
  FROM scored JOIN norm USING (doc) WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_simhash_near_dedup,
        op2_quality_classifier,
        op3_exact_dedup,
        op4_benchmark_decontamination,
        op4_benchmark_proximity,
        op5_pii,
        op6_line_dedup,
        op6_line_dedup_after_changes,
        op7_language_id,
        op8_suffix_array_dedup,
        op9_bpe_encode_decode,
        op10_chat_formatting,
        op11_warc_archive,
        op12_ranked_search,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def sql_texts() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_line_dedup": OP6_SQL, "op6_line_dedup_after_changes": OP6_SQL, "op11_warc_archive": OP11_SQL, "op12_ranked_search": OP12_SQL}
