"""The queries of the training-data operators, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bagminhash, bpe, hosts, langid, ogg, packing, pseudo_lm, repetition, substrings, warc
from kinweave.llm.shared import materialise

HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.probe(ogg.encode(table(spark, sf_dir, "documents")))


def op2_bpe_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT


def op4_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = langid.predict(docs, learned)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = materialise(pseudo_lm.count_words(docs, pseudo_lm.Settings(), "text"), "counts")
    return pseudo_lm.score(docs, pseudo_lm.fit(docs, counted=counted), counted=counted)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op10_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ogg_media, op2_bpe_merge_replay, op3_host_reputation, op4_compression_langid, op5_vector_packing, op6_pseudo_likelihood, op7_substring_dedup, op8_warc_ranges, op9_bagminhash, op10_repetition_coverage, pipeline)
}

OP8_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, payload FROM bodies),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS keep FROM digests)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN keep END AS refers_to FROM kept"""

#: SQL has no compression, merge replay, training, hashing of weights or packing: the other operators are tested by other means.
SQL: dict[str, str] = {"op3_host_reputation": hosts.judge_sql(), "op8_warc_ranges": OP8_SQL, "op10_repetition_coverage": repetition.judge_sql()}
