"""The queries of this package's operators, with production parameters and, where SQL
can express a result, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_mixing, decontaminate, packing, quality, simhash, token_archive, topk, toxicity, url_filter, warc
from .common import crc_mod, scratch, table


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("k"), 3) != 1)
    return _judged(toxicity.score(docs, model, ["doc_id"]), crc_mod(F.col("doc_id"), 3) == 1)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, threshold=0.8)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(warc.to_records(table(spark, sf_dir, "pages")), path)
    return warc.page_rows(warc.read_archives(spark, path)).drop("url")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantise(table(spark, sf_dir, "embeddings"), scale=64)
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.apply_rules(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, capacity=4096)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("k"), 4) != 2)
    return _judged(quality.score(docs, model, ["doc_id"]), crc_mod(F.col("doc_id"), 4) == 2)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 1)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_archive.write_token_archive(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_archive.read_token_archive(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_warc": op3_warc,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_url_filters": op6_url_filters,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_token_ids": op10_token_ids,
}

ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
        ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM d)),
        bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM b)),
        n AS (SELECT item_id, count(*) AS size FROM bs GROUP BY item_id)
        SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(size) AS INTEGER) AS size, count(*) / any_value(size) AS containment
        FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(size)""",
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM k""",
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_url_filters": """
        WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (SELECT h.*, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
              FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1""",
}
