"""Queries of the operators that work on words: encoding, spelling variants, ranked search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import bpe, ranking, spelling
from cliploom.llm.common import table


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(table(spark, folder, "documents"), decoded=True)
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_spellings(table(spark, folder, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n")


def op13_ranking(spark: SparkSession, folder: str) -> DataFrame:
    index = ranking.build_index(table(spark, folder, "documents"))
    return ranking.search(index, table(spark, folder, "benchmark")).select(
        "item_id", "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {q.__name__: q for q in (op11_bpe, op12_spelling, op13_ranking)}
