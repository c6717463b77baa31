"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import alignment, bpe, chat, decontaminate, exact_dedup, langid, lm, near_dedup, packing, pii, secrets, warc, whitening
from fleetlens.llm.common import documents, importable


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(documents(spark, sf_dir))
    return langid.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_control_case(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept", "class_id", "n_links")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(documents(spark, sf_dir))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def _ready(query):
    return lambda spark, sf_dir: query(importable(spark), sf_dir)


QUERIES = {f.__name__: _ready(f) for f in (op1_pii, op2_exact_dedup, op3_bpe, op4_lm_score, op5_decontaminate, op6_secrets, op7_language, op8_chat, op9_minhash, op10_warc, op11_whitening, op12_alignment, op13_packing)}

ORACLE = {
    "op2_exact_dedup": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
hashed AS (SELECT doc_id, length(body) AS size, sha256(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS digest FROM texts),
kept AS (SELECT digest, arg_max(doc_id, (size, -doc_id)) AS keep_id, count(*) AS group_size FROM hashed GROUP BY digest)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM hashed JOIN kept USING (digest)""",
    "op8_chat": r"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS said FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    length(regexp_replace(said, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS written
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(said)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written + CASE WHEN opens THEN 12 + length(role) + 10 + 10 ELSE 11 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op10_warc": r"""
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM bodies),
coded AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, (1 + 5 * (j // 4))::INT, 5))::INT >> (15 - 5 * (j % 4))::INT) & 31))::INT, 1)), '') AS payload_digest FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(min(page_id) OVER w, page_id) AS refers_to
FROM coded WINDOW w AS (PARTITION BY payload_digest)""",
}
