"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeflow.llm.common import held_out, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages for their directories: doc_id is null for a page, page_id for a document."""
    from tapeflow.llm.licenses import document_files, page_files, scan

    docs, pages = document_files(table(spark, sf_dir, "documents")), page_files(table(spark, sf_dir, "pages"))
    return scan(docs.unionByName(pages, allowMissingColumns=True), ("doc_id", "page_id"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.quality_rules import quality

    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"]
    return quality(table(spark, sf_dir, "documents")).select(own)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.classifier import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model, _ = train(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.url_filters import filter_urls, junk_listed

    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages.select("page_id", "url"), listed=junk_listed(pages))
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out("doc_id", 3, 1)
    model = train(docs, ~out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeflow.llm.pii import digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_URL = """
WITH rest AS (
  SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), host AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM rest
), parsed AS (
  SELECT page_id, html, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM host
), listed AS (
  SELECT DISTINCT host || regexp_replace(path, '/+$', '') AS key FROM parsed
  WHERE host <> '' AND regexp_matches(html, '<title>[^<]*(###|\\$\\$\\$|%%%|&&&|\\*\\*\\*)')
), judged AS (
  SELECT page_id, host, path, host <> '' AND host || regexp_replace(path, '/+$', '') IN (SELECT key FROM listed) AS on_list,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN on_list THEN 'block' ELSE 'allow' END AS verdict,
  on_list AS listed
FROM judged
"""

ORACLES = {"op8_url_filters": _URL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
