"""The queries opN_<name> over the corpus tables, and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, exact_dedup, html_text, language_id, line_dedup, near_dedup, token_counts, toxicity, warc
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return toxicity.score(rows, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep_text=False)


def op4_line_dedup(spark, sf_dir):
    return line_dedup.document_lines(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), "text")
    return language_id.identify(rows, language_id.fit(docs), keep_text=False)


def op7_byte_level_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.document_token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op9_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_words", "kept")


def op10_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_byte_level_bpe": op7_byte_level_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_warc": op10_warc,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS m, unnest(range(1, len(w) - n + 2)) AS t(i)
),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON d.doc_id = spots.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP5 = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

OP10 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT *, sha1(encode(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

ORACLE_SQL = {"op10_warc": OP10, "op2_benchmark_decontamination": OP2, "op5_exact_dedup": OP5}
