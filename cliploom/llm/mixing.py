"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, -ln(u) / weight, with u from the digest of its id
(Efraimidis and Spirakis: taking the smallest keys first is sampling without replacement with
probability in proportion to the weights). A source takes as many complete epochs as fit in its
token target; the rest of the target is filled from the documents in the order of their keys.

Keys are laid out in a fixed number of bins. Sizes are summed per (source, bin) on the map side,
prefix sums over the bins give the bin where the target falls, and only the documents of that one
bin are sorted. A source with a third of all rows thus never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import column, hex_number, word_count
from cliploom.session import write_stage

WEIGHTS = (5, 2, 1)
BINS = 1 << 16


def quality_weight(text: Column, size: Column) -> Column:
    """Words / (words + symbols): 1 for plain prose, less the more symbols; 1 without words."""
    given = F.coalesce(text, F.lit(""))
    symbols = F.length(given) - F.length(F.translate(given, "#*$%&|<>", ""))
    return F.when(size > 0, size / (size + symbols).cast("double")).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: tuple[int, int],
                   most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn. They share
    share[0]/share[1] of all sizes by weight, each at most `most` times its own size; what is cut
    off goes to the others by weight until none is above. With sources in the order of
    size / weight, those that are cut are a prefix, so running sums settle it without rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.select(
        "source", "source_size", (F.col("source_size") * most).alias("cap"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long").alias("w"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = weighed.select(
        "*", F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .alias("w_left"))
    left = F.col("total") * share[0] - F.col("cap_before") * share[1]
    marked = ranked.select(
        "*", (left * F.col("w") > F.col("cap") * share[1] * F.col("w_left")).alias("cut"),
        (left.cast("double") / share[1] / F.col("w_left")).alias("level"))
    # the first source that is not cut has the largest w_left among those
    level = F.max(F.when(~F.col("cut"), F.struct("w_left", "level"))).over(everything)
    return marked.select(
        "source", "source_size",
        F.when(F.col("cut"), F.col("cap").cast("double"))
        .otherwise(F.col("w") * level["level"]).alias("target"))


def sampling_key(row_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight; ids that are null share one u, weights that are null or not positive
    count as 1."""
    named = F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit("/" + seed))
    u = (hex_number(F.md5(named), 13) + 0.5) / float(1 << 52)
    return -F.log(u) / F.when(weight > 0, weight).otherwise(1.0)


def draw(docs: DataFrame, seed: str = "mix", whole: bool = False) -> DataFrame:
    """doc_id, source, size, key and bin of every document; with `whole`, the row itself too."""
    row = F.struct(*[column(c).alias(c) for c in docs.columns]) if whole else F.lit(None)
    size = word_count(column("text"))
    sized = docs.select(
        column("doc_id").alias("doc_id"), column("source").alias("source"), row.alias("row"),
        size.alias("size"), quality_weight(column("text"), size).alias("weight"))
    keyed = sized.select("doc_id", "source", "row", "size", sampling_key(
        F.col("doc_id"), F.col("weight"), seed).alias("key"))
    at = F.least(F.floor((1 - F.exp(-F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int")
    return keyed.withColumn("bin", at) if whole else keyed.withColumn("bin", at).drop("row")


def plan_mix(drawn: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2),
             most: int = 2) -> DataFrame:
    """Per source (plan_source): source_size, target, epochs, rest (what the target leaves after
    whole epochs), and the bin where the rest ends with the words before it; no bin if the rest
    takes all."""
    bins = write_stage(drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                    ).otherwise(0).cast("long")
    plan = write_stage(
        targets.withColumn("epochs", epochs).withColumn(
            "rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    same = F.col("source").eqNullSafe(F.col("s"))
    ends = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    cuts = (
        bins.withColumn("bin_end", ends)
        .join(plan.select(F.col("source").alias("s"), "rest"), same)
        .where("bin_end > rest").groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("bin_end") - F.col("bin_size")).alias("start")))
             .alias("cut"))
    )
    return write_stage(
        plan.join(cuts.select(F.col("source").alias("s"), "cut"), same, "left")
        .select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "rest",
                F.col("cut.bin").alias("cut_bin"), F.col("cut.start").alias("cut_start")), "plan")


def apply_mix(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """drawn with source_size, target, copies and taken = size * copies."""
    rows = drawn.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    sure = rows.where("cut_bin is null or bin <> cut_bin").withColumn(
        "last", F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    before = F.col("cut_start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    close = rows.where("bin = cut_bin").withColumn(
        "last", before + F.col("size") / 2 <= F.col("rest"))
    copies = F.col("epochs") + (F.col("last") & (F.col("source_size") > 0)).cast("long")
    return sure.unionByName(close).select(
        *drawn.columns, "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null: 0). copies: how often the mix takes the document, whole;
    taken = size * copies. A document enters the last, partial epoch if its middle lies within
    what the target leaves, so a source misses its target by half a document at most. Rows with
    equal keys (repeated rows) are ordered by id and size; among rows equal in these either may
    be taken, with the same figures. A source without words has target 0 and copies 0. An empty
    table gives an empty result. Further columns are ignored, whatever their names."""
    drawn = write_stage(draw(docs), "drawn")
    return apply_mix(drawn, plan_mix(drawn)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their own columns alone."""
    plan = plan_mix(write_stage(draw(docs), "drawn"))
    taken = apply_mix(draw(docs, whole=True), plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
