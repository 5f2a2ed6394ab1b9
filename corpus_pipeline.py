"""Documents to packed sequences: language, quality, near duplicates, repeated passages, packing.

Defined results: rows with a null text, or one without a letter, go in the first stage; equal ids are one document,
whose distinct texts stay or go together, once each; a null id is a document of its own; an empty table gives an empty
table; further columns, whatever their names, are left out; texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bagminhash, langid, packing, repetition, substrings
from kinweave.llm.shared import new_path, remove, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the dictionaries come from a bounded sample of the labelled rows."""
    learned = langid.learn(docs, F.lit(True))
    return langid.predict(docs, learned, carry=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.judge(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays."""
    kept = bagminhash.classes(docs).filter("doc_id IS NULL OR doc_id = class_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = named.join(shared, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_one")).select("doc_id", "text", "_one.*")
    return named.join(shared, "doc_id", "left_anti").unionByName(once).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier one holds; texts without any stay as they are."""
    others = tuple(c for c in COLUMNS if c not in ("doc_id", "n_chars"))
    found = substrings.remove_repeats(docs, carry=others)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text") != "").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: SQL can't express compression, signatures and packing: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents, each stage written and read again; what a stage needed is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
