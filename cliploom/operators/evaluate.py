"""Metrics over decisions, boundaries and human reference clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.columns import ms, overlap_ratio

MATCH_IOU = 0.50
_MINUTE = 60.0


def boundary_stats(scored: DataFrame) -> DataFrame:
    """Per run: boundaries moved, mean move, reverted clips, anchors used."""
    a, b = F.abs(ms(F.col("start_delta"))), F.abs(ms(F.col("end_delta")))
    kinds = ("segment_start", "word_start", "segment_end", "word_end", "unchanged")
    used = [
        (F.count_if(F.col("start_anchor_kind") == k) + F.count_if(F.col("end_anchor_kind") == k))
        .alias(f"anchor_{k}") for k in kinds
    ]
    return scored.groupBy("run_id").agg(
        F.count("*").alias("candidates"),
        (F.count_if(a > 0) + F.count_if(b > 0)).alias("moved_boundaries"),
        (F.sum(a + b) / (F.count("*") * 2)).alias("mean_abs_ms"),
        F.count_if("reverted").alias("reverted"), *used,
    )


def acceptance_rates(decided: DataFrame) -> DataFrame:
    """Acceptance and edit rates per run, per category, per both, and overall."""
    n = F.count("*")
    kinds = {k: F.count_if(F.col("decision") == k) for k in ("approved", "edited", "rejected")}
    sets = [[F.col("run_id"), F.col("category")], [F.col("run_id")], [F.col("category")], []]
    return decided.groupingSets(sets, "run_id", "category").agg(
        F.grouping_id().cast("bigint").alias("level"), n.alias("presented"),
        *[c.alias(k) for k, c in kinds.items()],
        (kinds["approved"] / n).alias("acceptance_rate"), (kinds["edited"] / n).alias("edit_rate"),
    )


def rejection_distribution(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts of the reasons of our rules and of editorial reasons, kept as two vocabularies."""
    ours = outcomes.select(F.explode("rejection_reasons").alias("reason")).groupBy("reason").agg(
        F.count("*").alias("n")).withColumn("vocabulary", F.lit("rules"))
    theirs = decisions.where("decision = 'rejected' AND reason IS NOT NULL").groupBy("reason").agg(
        F.count("*").alias("n")).withColumn("vocabulary", F.lit("editorial"))
    return ours.unionByName(theirs)


def match_reference(candidates: DataFrame, reference: DataFrame, threshold: float = MATCH_IOU
                    ) -> DataFrame:
    """For every clip the candidate that overlaps it most, for every candidate the clip, above
    the threshold; a pair that is both is one row. Other pairs are not listed, so the result
    follows clips and candidates, not their product.

    Both sides meet by (run, minute); a pair counts in the one minute where both are first on.
    """
    def minutes(df: DataFrame) -> DataFrame:
        return df.withColumn("minute", F.explode(F.sequence(
            F.floor(F.col("start") / _MINUTE), F.floor(F.col("end") / _MINUTE))))

    left = minutes(candidates.select("run_id", "candidate_id", "start", "end"))
    right = minutes(reference.select("run_id", "clip_no", "start", "end")).withColumnsRenamed(
        {"start": "clip_start", "end": "clip_end"})
    once = F.col("minute") == F.floor(F.greatest("start", "clip_start") / _MINUTE)
    iou = overlap_ratio(F.col("start"), F.col("end"), F.col("clip_start"), F.col("clip_end"))
    pairs = left.join(right, ["run_id", "minute"]).where(once).withColumn("iou", iou).where(
        F.col("iou") > threshold)
    best = F.max(F.struct(
        "iou", "candidate_id", "clip_no",
        ms(F.abs(F.col("start") - F.col("clip_start"))).alias("start_error_ms"),
        ms(F.abs(F.col("end") - F.col("clip_end"))).alias("end_error_ms"))).alias("b")
    keys = ["run_id", "candidate_id", "clip_no", "iou", "start_error_ms", "end_error_ms"]
    sides = [
        pairs.groupBy("run_id", side).agg(best).select("run_id", "b.*", *[
            F.lit(side == own).alias(flag) for own, flag in (
                ("clip_no", "best_for_clip"), ("candidate_id", "best_for_candidate"))])
        for side in ("clip_no", "candidate_id")
    ]
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(
        F.max("best_for_clip").alias("best_for_clip"),
        F.max("best_for_candidate").alias("best_for_candidate"))


def evaluation_metrics(candidates: DataFrame, reference: DataFrame, matches: DataFrame
                       ) -> DataFrame:
    """Per run: match rate, recall, mean overlap and mean boundary errors."""
    presented = candidates.groupBy("run_id").agg(F.count("*").alias("presented"))
    wanted = reference.groupBy("run_id").agg(F.count("*").alias("clips"))
    own = matches.where("best_for_candidate").groupBy("run_id").agg(
        F.count("*").alias("matched_candidates"))
    best = matches.where("best_for_clip").groupBy("run_id").agg(
        F.count("*").alias("matched_clips"),
        F.sum(F.round(F.col("iou") * 1_000_000).cast("bigint")).alias("iou_sum"),
        F.sum("start_error_ms").alias("start_sum"), F.sum("end_error_ms").alias("end_sum"))
    zero = F.lit(0).cast("bigint")
    n = F.col("matched_clips")
    return (
        presented.join(wanted, "run_id", "full_outer").join(own, "run_id", "left")
        .join(best, "run_id", "left")
        .select(
            "run_id", F.coalesce("presented", zero).alias("presented"),
            F.coalesce("clips", zero).alias("clips"),
            (F.coalesce("matched_candidates", zero) / F.col("presented")).alias("match_rate"),
            (F.coalesce("matched_clips", zero) / F.col("clips")).alias("recall"),
            (F.col("iou_sum") / n / 1_000_000).alias("mean_iou"),
            (F.col("start_sum") / n).alias("mean_start_error_ms"),
            (F.col("end_sum") / n).alias("mean_end_error_ms"),
        )
    )


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact medians of whole-number columns per key: how often each value occurs is counted before
    the shuffle, and the counts are added up in order of value. What meets in one place are the
    different values of a key, not its rows, and no value list is held as one cell."""
    one = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).alias("value")) for v in values]))
    counts = rows.select(*keys, one.alias("v")).select(*keys, "v.*").where("value IS NOT NULL").groupBy(
        *keys, "name", "value").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys, "name")
    upto = F.sum("n").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("last", F.sum("n").over(whole) - 1)
    middle = [F.min(F.when(F.col("upto") > at, F.col("value")))
              for at in (F.floor(F.col("last") / 2), F.ceil(F.col("last") / 2))]
    found = placed.groupBy(*keys, "name").agg(((middle[0] + middle[1]) / 2).alias("median"))
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == v, F.col("median"))).alias(f"median_{v}") for v in values])


def boundary_error(edited: DataFrame) -> DataFrame:
    """Per category: distance between the snapped and the human boundaries of edited clips."""
    start = F.abs(ms(F.col("final_start")) - ms(F.col("original_start")))
    end = F.abs(ms(F.col("final_end")) - ms(F.col("original_end")))
    moved = edited.where("decision = 'edited'").select(
        "category", start.alias("start_ms"), end.alias("end_ms"))
    means = moved.groupBy("category").agg(
        F.count("*").alias("edited"), (F.sum("start_ms") / F.count("*")).alias("mean_start_ms"),
        (F.sum("end_ms") / F.count("*")).alias("mean_end_ms"))
    return means.join(medians(moved, ["category"], ["start_ms", "end_ms"]), "category", "left")


def run_report(runs: DataFrame, funnel: DataFrame, counts: DataFrame, timings: DataFrame
               ) -> DataFrame:
    """One row per run: length, stage seconds, funnel, decisions, acceptance rate."""
    presented = F.col("approved") + F.col("edited") + F.col("rejected")
    return (
        runs.join(funnel, "run_id", "left").join(counts, "run_id", "left")
        .join(timings, "run_id", "left")
        .withColumn("valid", F.col("proposed") - F.col("invalid"))
        .withColumn("presented", presented)
        .withColumn("acceptance_rate",
                    F.when(presented > 0, F.col("approved") / presented))
    )
