"""Queries of the operators that work on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import decontam, linededup, quality, simhash, tokens, toxicity
from cliploom.llm.common import table
from cliploom.session import write_stage


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    measured = write_stage(
        quality.measure(table(spark, folder, "documents"), "doc_id"), "measured")
    judged = quality.judge(measured, quality.fit(measured))
    return judged.select(
        F.col("keep_doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "distance")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    marked = write_stage(
        docs.select("doc_id", simhash.fingerprints("text").alias("fp")), "fingerprints")
    found = simhash.near_duplicates(marked)
    return marked.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first_id").alias("component_id"))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    index = decontam.build_index(table(spark, folder, "documents"))
    matches = decontam.search(index, table(spark, folder, "benchmark"))
    return decontam.contamination(index, matches).select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.deduplicate_lines(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.count_tokens(table(spark, folder, "documents"))


QUERIES = {q.__name__: q for q in (op1_quality, op2_toxicity, op3_simhash, op4_decontamination,
                                op6_line_dedup, op7_token_counts)}
