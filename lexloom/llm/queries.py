"""The operators' queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, table
from . import bpe_codec, decontaminate, html_text, kneser_ney, passages, quality, simhash, token_counts, vector_forest, warc


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.archived(spark, path)


def op5_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.lm_scores(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_text, op2_decontaminate, op3_token_counts, op4_warc, op5_vector_forest, op6_simhash, op7_quality, op8_passages, op9_bpe_codec, op10_lm_scores)}
ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages),
        k AS (SELECT d, n, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d, n)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN coalesce(page_id, keeper - 1) < keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN coalesce(page_id, keeper - 1) < keeper THEN keeper END AS refers_to
        FROM p LEFT JOIN k USING (d, n)""",
    "op5_vector_forest": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
                 WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
                 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON reach.r = link.a),
        part AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM part LEFT JOIN n USING (vec_id)""",
}
