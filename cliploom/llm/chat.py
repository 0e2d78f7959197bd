"""Chat formatting of reply trees.

Messages point to the message they answer. Root-to-leaf paths are enumerated by self-joins that
double their reach each round: after k rounds a leaf knows its ancestors nearer than 2^k, so a
thread of a thousand turns takes ten rounds and the rows are the path members, nothing more.
Branches are ranked by the mean score of their messages, and each chosen path becomes one
conversation.

Template: every turn is `<|role|>`, a line feed, the text, `</s>` and a line feed. Inside roles
and texts the characters backslash, `<`, `[` and `|` are written as backslash and a digit, so no
control string (`<|`, `</s>`, `[INST]` ...) can occur there and reading back is exact. The loss
mask is a list of character spans [start, end) of the assistant texts in the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.session import write_stage

#: What stands in a text, and what is written for it. The escape itself is first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("|", "\\3"))
OPEN, NAMED, CLOSE = "<|", "|>\n", "</s>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def thread(messages: DataFrame, conversation: str, turn: str) -> DataFrame:
    """(conv_id, node, parent, role, text) of plain conversations: each turn answers the one
    before it. Equal turns are ordered by role and text; null turns come first."""
    order = Window.partitionBy(conversation).orderBy(
        F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(),
        F.col("text").asc_nulls_first())
    node = F.row_number().over(order)
    return messages.select(
        F.col(conversation).alias("conv_id"), node.alias("node"), "role", "text"
    ).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, height): every message on a root-to-leaf path, height counted from
    the leaf. tree has conv_id, node, parent. A message whose parent is null or unknown is a
    root. Messages that lie on a cycle, or answer into one, have no root and no path."""
    nodes = write_stage(
        tree.select(F.struct("conv_id").alias("conv"), "node", "parent").where("node is not null"),
        "nodes")
    known = nodes.select("conv", F.col("node").alias("parent"))
    up = write_stage(nodes.join(known, ["conv", "parent"], "left_semi")
                     .select("conv", "node", "parent"), "up")
    found = write_stage(
        nodes.join(up.select("conv", F.col("parent").alias("node")), ["conv", "node"], "left_anti")
        .select("conv", F.col("node").alias("leaf"), "node", F.lit(0).alias("height")), "leaves")
    rooted = nodes.join(up, ["conv", "node"], "left_anti").select("conv", "node")
    largest = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < largest and not up.isEmpty():
        grown = found.join(up, ["conv", "node"]).select(
            "conv", "leaf", F.col("parent").alias("node"),
            (F.col("height") + reach).alias("height"))
        found = write_stage(found.union(grown), "paths")
        further = up.select("conv", F.col("node").alias("parent"), F.col("parent").alias("far"))
        up = write_stage(up.join(further, ["conv", "parent"])
                         .select("conv", "node", F.col("far").alias("parent")), "up")
        reach *= 2
    ended = found.join(rooted, ["conv", "node"], "left_semi").select("conv", "leaf")
    return found.join(ended, ["conv", "leaf"], "left_semi").select(
        "conv.conv_id", "leaf", "node", "height")


def best_paths(members: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """The members of the `top` branches of each conversation, with their rank from 1: highest
    mean score first (null scores count as 0), then the smaller leaf. scores: conv_id, node,
    score."""
    scored = members.join(
        scores.select(F.struct("conv_id").alias("c"), F.col("node").alias("n"), "score"),
        (F.struct("conv_id") == F.col("c")) & (F.col("node") == F.col("n")))
    branches = scored.groupBy("conv_id", "leaf").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "leaf")
    chosen = branches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    chosen = chosen.select(F.struct("conv_id").alias("c"), F.col("leaf").alias("l"), "rank")
    return members.join(
        chosen, (F.struct("conv_id") == F.col("c")) & (F.col("leaf") == F.col("l"))
    ).select("conv_id", "leaf", "node", "height", "rank")


def format_paths(members: DataFrame, tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, formatted, loss): one conversation per chosen path, root first. Null roles
    and texts are empty. loss: array of (start, end) in characters."""
    said = tree.select(F.struct("conv_id").alias("c"), F.col("node").alias("n"),
                       F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    body = escape(F.col("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(NAMED))
    turns = members.join(
        said, (F.struct("conv_id") == F.col("c")) & (F.col("node") == F.col("n"))
    ).select("conv_id", "leaf", "height", (F.col("role") == LOSS_ROLE).alias("learnt"),
             F.concat(head, body, F.lit(CLOSE)).alias("piece"),
             F.length(head).alias("text_at"), F.length(body).alias("text_chars"))
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.col("height").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("text_at")
    placed = turns.withColumn("start", start)
    span = F.struct("start", (F.col("start") + F.col("text_chars")).alias("end"))
    pieces = F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("at"), "piece")))
    return placed.groupBy("conv_id", "leaf").agg(
        F.array_join(pieces["piece"], "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("learnt"), span))).alias("loss"))


def format_trees(tree: DataFrame, top: int = 1) -> DataFrame:
    """Format the best branches of every tree. tree: conv_id, node, parent, role, text and,
    if branches are to be ranked by more than their leaf, score. Further columns are ignored. An
    empty table gives an empty result; repeated (conv_id, node) rows are the same message twice
    and must be told apart by the caller."""
    score = F.col("score").cast("double") if "score" in tree.columns else F.lit(0.0)
    tree = tree.select("conv_id", "node", "parent", "role", "text", score.alias("score"))
    tree = write_stage(tree, "tree")
    members = best_paths(paths(tree), tree, top)
    return format_paths(members, tree)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.slice(F.split(formatted, "</s>\n"), 1, F.size(F.split(formatted, "</s>\n")) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, NAMED, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(head) + len(NAMED) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
