"""The registered queries of the operators in this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chaining, extraction, lexical, mixing, negatives, outliers, packing, sharding, simhash, substring_exact, topk, toxicity
from .common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_exact.without_repeats(table(spark, sf_dir, "documents"), most=100)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chaining.without_passages(table(spark, sf_dir, "documents"), least=50, similar=0.8)
    return rows.select("doc_id", "component_id", "n_words", "n_removed", "n_passages", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, most=3)


def op8_cross_polytope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), most=2048)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outliers.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_collinear_chaining": op2_collinear_chaining,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_cross_polytope_search": op8_cross_polytope_search,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_outliers": op13_quality_outliers,
}
SQL: dict[str, str] = {
    "op11_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     i AS (SELECT row_number() OVER () AS item_at, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
     c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
     asked AS (SELECT item_at, term, count(*) AS times FROM (SELECT item_at, unnest(terms) AS term FROM i) GROUP BY ALL),
     tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
     m AS (SELECT place, doc_id, 100 - 25 + ((25 * len(terms) * n_docs) // n_terms) AS m FROM d, c),
     s AS (SELECT item_at, place, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (place) GROUP BY ALL),
     r AS (SELECT item_at, doc_id, score, row_number() OVER (PARTITION BY item_at ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (place) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN i USING (item_at) WHERE rank <= 20""",
    "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS at, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.at AS a_at, a.vec_id AS anchor_id, a.label AS a_label, b.at, b.vec_id, b.label, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.at <> b.at),
     p AS (SELECT * FROM s WHERE label = a_label QUALIFY row_number() OVER (PARTITION BY a_at ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.a_at, p.at ORDER BY s.score DESC, s.vec_id) AS rank
           FROM p JOIN s ON p.a_at = s.a_at AND s.label <> p.a_label AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
