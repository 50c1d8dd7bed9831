"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortwise.llm import (
    decontaminate,
    masked_lm,
    near_dups,
    neighbours,
    packing,
    periods,
    phrases,
    pii,
    records,
    resampling,
    toxicity,
    urls,
    vector_packing,
)
from cohortwise.llm.common import settle, table
from cohortwise.session import scratch_path


def op1_int8_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(settle(spark, "4096"), sf_dir, "embeddings"), "vec_id % 20 = 0")


def op2_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(settle(spark), sf_dir, "pages"))


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_corpus(table(settle(spark), sf_dir, "documents"))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.strip_repeats(table(settle(spark), sf_dir, "documents"), with_text=False).drop("kept")


def op5_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(table(settle(spark), sf_dir, "documents"))


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(settle(spark), sf_dir, "documents"))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    path, index_path = scratch_path(spark, "records"), scratch_path(spark, "index")
    records.write_records(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    records.write_index(spark, path, index_path)
    return records.read_index(spark, index_path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return periods.find_runs(docs, with_text=False, prepare=periods.planted).drop("runs", "collapsed")


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(settle(spark), sf_dir, "documents")
    return vector_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


QUERIES = {
    "op1_int8_block_join": op1_int8_block_join,
    "op2_url_language_model": op2_url_language_model,
    "op3_masked_pseudo_likelihood": op3_masked_pseudo_likelihood,
    "op4_repeated_phrases": op4_repeated_phrases,
    "op5_anchor_pii": op5_anchor_pii,
    "op6_weighted_minhash": op6_weighted_minhash,
    "op7_string_kernel_toxicity": op7_string_kernel_toxicity,
    "op8_bm25_decontamination": op8_bm25_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_binary_records": op10_binary_records,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_vector_packing": op13_vector_packing,
}

# Sums component after component in double precision, as the operator does.
_OP1 = """
WITH vectors AS (
    SELECT vec_id, min(list_transform(embedding, lambda x: x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id, score
FROM pairs
QUALIFY rank <= 20
"""

# CRC-32 from its definition: a table of 256 entries by eight shifts each, then byte after byte.
_OP11 = """
WITH crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(
        range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS entries
), texts AS (
    SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL
    SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
    SELECT side, row, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS words
    FROM texts
), features AS (
    SELECT side, row, unnest(words) AS word FROM worded
), bucketed AS (
    SELECT word, xor(list_reduce(
        list_transform(range(strlen(word)), lambda k: CAST('0x' || hex(encode(word))[2 * k + 1:2 * k + 2] AS BIGINT)),
        lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM features), crc
), counts AS (
    SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t
    FROM features JOIN bucketed USING (word) GROUP BY bucket
), totals AS (
    SELECT COALESCE(sum(s), 0)::BIGINT AS all_s, COALESCE(sum(t), 0)::BIGINT AS all_t FROM counts
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))))::BIGINT AS gain
    FROM counts, totals
), weights AS (
    SELECT row, sum(gain)::BIGINT AS weight
    FROM features JOIN bucketed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row
), scored AS (
    SELECT doc_id, COALESCE(len(words), 0)::BIGINT AS n_features, COALESCE(weight, 0)::BIGINT AS weight,
           COALESCE(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
               (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
               AS score
    FROM worded LEFT JOIN weights USING (row) WHERE side = 'd'
), placed AS (
    SELECT *, score IS NOT NULL AND n_features >= 20 AS able,
           row_number() OVER (PARTITION BY score IS NOT NULL AND n_features >= 20
                              ORDER BY score DESC, doc_id, n_features, weight) AS place,
           count(*) OVER (PARTITION BY score IS NOT NULL AND n_features >= 20) AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (10 * n) // 100 THEN place END AS rank FROM placed
"""

SQL: dict[str, str] = {"op1_int8_block_join": _OP1, "op11_importance_resampling": _OP11}
