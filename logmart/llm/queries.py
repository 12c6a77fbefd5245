"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmart.llm import (
    chat_format,
    decontaminate,
    embedding_dedup,
    importance_resample,
    jaccard_join,
    line_dedup,
    oracles,
    packing,
    periodic_runs,
    quality_llr,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    warc,
)
from logmart.llm.common import table
from logmart.session import scratch_path


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_llr.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(
        F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False).drop("ids")
    return packing.pack(pieces)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                 "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.conversation_digests(chat_format.examples(turns))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words that the contract of op11 reads a text as: one in
    ten ends in repeats of a stretch of its words. Null ids: as it is."""
    h = crc32(b"%d" % doc_id) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.collapse(table(spark, sf_dir, "documents"), rewrite=planted))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_importance_resample": op13_importance_resample,
}

#: CRC-32 of the UTF-8 bytes of word ``w``, bit by bit over its hex digits.
CRC32_SQL = """xor(4294967295, list_reduce(list_transform(range(1, strlen(w) + 1), lambda i:
    16 * (strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i - 1, 1)) - 1)
    + strpos('0123456789ABCDEF', substr(hex(encode(w)), 2 * i, 1)) - 1),
  lambda c, b: list_reduce(range(8), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT))"""

ORACLES = oracles.ORACLES | {
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM embeddings""",
    "op13_importance_resample": f"""
WITH word AS (
  SELECT src, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
  FROM (SELECT 0 AS src, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
coded AS (SELECT w, {CRC32_SQL} % 10000 AS bucket FROM (SELECT DISTINCT w FROM word)),
feature AS (SELECT src, doc_id, bucket FROM word JOIN coded USING (w)),
gain AS (
  SELECT bucket, count(*) FILTER (src = 0) AS s, count(*) FILTER (src = 1) AS t,
    floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM feature GROUP BY bucket),
scored AS (
  SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_features, coalesce(f.weight, 0)::BIGINT AS weight,
    coalesce(f.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                               / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n, sum(g) AS weight FROM feature JOIN gain USING (bucket) WHERE src = 0 GROUP BY doc_id) f
    USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed""",
}
