"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.session import write_stage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(docs: DataFrame, key: Column, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose key (an expression over docs, never null) is in wanted's only column.
    Rows travel as one struct, so no name of docs can clash with another."""
    row = F.struct(*[column(c).alias(c) for c in docs.columns]).alias("row")
    named = wanted.toDF("wanted")
    return docs.select(row, key.alias("key")).join(
        named, F.col("key") == F.col("wanted"), how).select("row.*")


def without(docs: DataFrame, key: Column, unwanted: DataFrame) -> DataFrame:
    return only(docs, key, unwanted, "left_anti")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def hex_number(digest: Column, digits: int = 15) -> Column:
    """The first hex digits of a digest as a non-negative number (15 digits fill 60 bits)."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): one row (node, root) per linked node.

    root is the smallest node of the component. Every round takes the smallest root among a
    node's neighbours and then follows roots once (pointer jumping), so the number of rounds
    follows the logarithm of the longest chain. Rows stay as many as nodes and links; each
    round is a written table, so a lost executor costs tasks, not rounds.
    """
    both = write_stage(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "links")
    roots = write_stage(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        # `was` is the root before this round: equal everywhere once nothing moves
        lowered = write_stage(
            roots.join(near, "node")
            .select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")),
            "lowered")
        jumped = write_stage(
            lowered.join(
                lowered.select(F.col("node").alias("root"), F.col("root").alias("up")), "root")
            .select("node", "was", F.col("up").alias("root")), "jumped")
        roots = jumped.select("node", "root")
        if jumped.where("was <> root").isEmpty():
            return roots
