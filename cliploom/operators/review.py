"""Human decisions: validity, coherence with the shortlist, and the clips that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import close, first_problem, is_blank, is_utc_stamp, reasons
from cliploom.operators.ledger import admitted, ledger, ranked

KEYS = ["run_id", "candidate_id"]


def _moved() -> Column:
    return ~(close(F.col("final_start"), F.col("original_start"))
             & close(F.col("final_end"), F.col("original_end")))


def decision_problems(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Every decision with all the rules it breaks; empty when it is sound."""
    c = F.col
    kind, has_final = c("decision"), c("final_start").isNotNull() & c("final_end").isNotNull()
    approved, edited, rejected = (kind == k for k in ("approved", "edited", "rejected"))
    repeated = decisions.groupBy(*KEYS).agg((F.count("*") > 1).alias("_repeated"))
    known = runs.select("run_id", "duration", F.lit(True).alias("_known"))
    joined = decisions.join(known, "run_id", "left").join(repeated, KEYS)
    return joined.withColumn("problems", reasons([
        ("unknown_run", c("_known").isNull()),
        ("unknown_decision", ~kind.isin("approved", "edited", "rejected")),
        ("timestamp_not_utc", ~F.coalesce(is_utc_stamp(c("reviewed_at")), F.lit(False))),
        ("original_not_ordered",
         (c("original_start") < 0) | (c("original_end") <= c("original_start"))),
        ("interval_missing", (approved | edited) & ~has_final),
        ("final_negative", (c("final_start") < 0) | (c("final_end") < 0)),
        ("approved_moved", approved & has_final & _moved()),
        ("edited_not_ordered", edited & (c("final_end") <= c("final_start"))),
        ("edited_not_moved", edited & has_final & ~_moved()),
        ("rejected_with_interval",
         rejected & (c("final_start").isNotNull() | c("final_end").isNotNull())),
        ("reason_without_rejection",
         ~rejected & (c("reason").isNotNull() | c("detail").isNotNull())),
        ("unknown_reason", c("reason").isNotNull() & ~c("reason").isin(*rules.EDITORIAL_REASONS)),
        ("detail_without_reason", c("detail").isNotNull() & c("reason").isNull()),
        ("other_needs_detail",
         (c("reason") == "other") & is_blank(F.coalesce(c("detail"), F.lit("")))),
        ("detail_too_long", F.length("detail") > rules.DETAIL_MAX_LENGTH),
        ("ends_beyond_source", c("final_end") > c("duration") + rules.TIME_EPSILON),
        ("repeated_candidate", c("_repeated")),
    ])).drop("_repeated", "duration", "_known")


def coherence_problems(decisions: DataFrame, selected: DataFrame, runs: DataFrame) -> DataFrame:
    """First way a decision contradicts the shortlist it claims to be about, or NULL."""
    own = selected.select(
        *KEYS, F.col("start").alias("_start"), F.col("end").alias("_end"))
    about = runs.select(
        "run_id", F.col("analysis_fingerprint").alias("_print"), F.col("duration").alias("_dur"),
        F.lit(True).alias("_known"))
    c = F.col
    return (
        decisions.join(about, "run_id", "left").join(own, KEYS, "left")
        .withColumn("problem", first_problem([
            ("unknown_run", c("_known").isNull()),
            ("other_analysis", c("analysis_fingerprint") != c("_print")),
            ("other_duration", ~close(c("source_duration"), c("_dur"))),
            ("not_selected", c("_start").isNull()),
            ("original_start_differs", ~close(c("original_start"), c("_start"))),
            ("original_end_differs", ~close(c("original_end"), c("_end"))),
        ]))
        .drop("_start", "_end", "_print", "_dur", "_known")
    )


def pending(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """Selected candidates nobody decided yet."""
    return selected.join(decisions.select(*KEYS), KEYS, "left_anti")


TARGET_PROBLEMS = ("decided_twice", "not_selected", "original_start_differs",
                   "original_end_differs", "pending")


def target_problems(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """(run_id, problem, rank): everything that keeps a run's review from naming its clips."""
    c = F.col
    own = selected.select(*KEYS, c("start").alias("_start"), c("end").alias("_end"))
    told = decisions.join(own, KEYS, "left").select("run_id", F.explode(reasons([
        ("not_selected", c("_start").isNull()),
        ("original_start_differs", ~close(c("original_start"), c("_start"))),
        ("original_end_differs", ~close(c("original_end"), c("_end"))),
    ])).alias("problem"))
    twice = decisions.groupBy(*KEYS).count().where("count > 1").select(
        "run_id", F.lit("decided_twice").alias("problem"))
    late = pending(selected, decisions).select("run_id", F.lit("pending").alias("problem"))
    return ranked(twice.unionAll(told).unionAll(late), TARGET_PROBLEMS)


def clip_targets(selected: DataFrame, decisions: DataFrame) -> DataFrame:
    """Intervals to cut for runs whose review is finished and fits the shortlist; ranks keep their
    gaps. A run with any of target_problems has no clips at all.

    An approval takes the candidate's own interval, an edit the reviewer's.
    """
    taken = decisions.select(*KEYS, "decision", "final_start", "final_end")
    refused = ledger({"review": target_problems(selected, decisions)})
    edited = F.col("decision") == "edited"
    return (
        admitted(selected.select(*KEYS, "rank", "start", "end", "category", "total_score"), refused)
        .join(taken, KEYS)
        .where(F.col("decision").isin("approved", "edited"))
        .select(
            *KEYS, "rank", "decision", "category", "total_score",
            F.col("start").alias("original_start"), F.col("end").alias("original_end"),
            F.when(edited, F.col("final_start")).otherwise(F.col("start")).alias("start"),
            F.when(edited, F.col("final_end")).otherwise(F.col("end")).alias("end"),
        )
    )


def decision_counts(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Three counters per run, always all three."""
    counts = decisions.groupBy("run_id").agg(*[
        F.count_if(F.col("decision") == kind).alias(kind)
        for kind in ("approved", "rejected", "edited")
    ])
    zero = F.lit(0).cast("bigint")
    return runs.select("run_id").join(counts, "run_id", "left").select(
        "run_id", *[F.coalesce(k, zero).alias(k) for k in ("approved", "rejected", "edited")])


def latest_decision(log: DataFrame) -> DataFrame:
    """A later decision about a candidate replaces the earlier one."""
    return log.groupBy(*KEYS).agg(
        F.max_by("decision", F.struct("ts", "event_id")).alias("decision"),
        F.max(F.struct("ts", "event_id")).alias("_last"),
    ).select(*KEYS, "decision", F.col("_last.event_id").alias("event_id"))
