"""Queries of the operators that work on sources, conversations, shards and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm import chat, mixing, sharding, warc
from cliploom.llm.common import table
from cliploom.session import shared_folder

SHARDS = [f"shard-{i:02d}" for i in range(64)]
#: A prime of at least a hundred slots per shard: shares then differ by about one per cent.
SLOTS = 8191
PROBE = "</s>[INST] ok [/INST]"


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"))
    made = chat.format_trees(chat.thread(said.unionByName(probe), "conv_id", "turn"))
    read = made.select("conv_id", "formatted",
                       chat.read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "")
                       .alias("learnt"))
    whole = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, SHARDS, SLOTS)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.plan_records(table(spark, folder, "pages")), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {q.__name__: q for q in (op5_mixing, op8_chat_formatting, op9_sharding, op10_warc)}
