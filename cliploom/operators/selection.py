"""The whole funnel: validate, snap, score, filter, deduplicate, rank, cut."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import reasons
from cliploom.operators.chunking import chunk_extents_by_grid
from cliploom.operators.dedup import greedy_dedup
from cliploom.operators.proposals import (
    assess, place, snap, validation_reasons, weighted_total, with_anchors,
)
from cliploom.rules import Policy

OUTCOMES = ("invalid", "below_min_score", "deduplicated", "not_in_top_n", "selected")


def passes_min_score(total: Column, minimum: Column) -> Column:
    return total + F.lit(rules.SCORE_EPSILON) >= minimum


def settle(assessed: DataFrame, policy: Policy, keys: list[str] | None = None,
           columns: dict[str, Column] | None = None, stored: bool = False) -> DataFrame:
    """Give every assessed proposal its one outcome.

    Score filter first: a weak candidate must not absorb a strong one. ``columns`` replaces
    min_score, dedupe_iou and max_candidates by columns (a sweep over policies). ``stored``: see
    greedy_dedup.
    """
    keys = keys or ["run_id"]
    own = {
        "min_score": F.lit(policy.min_score), "max_candidates": F.lit(policy.max_candidates),
        **(columns or {}),
    }
    valid = F.size("invalid_reasons") == 0
    strong = passes_min_score(F.col("total_score"), own["min_score"])
    ready = assessed.withColumnsRenamed(
        {"start": "proposed_start", "end": "proposed_end", "adjusted_start": "start",
         "adjusted_end": "end"}
    )
    judged = greedy_dedup(
        ready, policy.dedupe_iou, keys, eligible=valid & strong,
        threshold_column=own.get("dedupe_iou"), stored=stored,
    )
    outcome = (
        F.when(~valid, F.lit("invalid"))
        .when(~strong, F.lit("below_min_score"))
        .when(F.col("kept_id").isNotNull(), F.lit("deduplicated"))
        .when(F.col("priority_rank") > own["max_candidates"], F.lit("not_in_top_n"))
        .otherwise(F.lit("selected"))
    )
    return (
        judged.withColumn("outcome", outcome)
        .withColumn("rank", F.when(F.col("outcome") == "selected", F.col("priority_rank")))
        .withColumn(
            "status",
            F.when(F.col("outcome") == "selected", F.lit("suggested"))
            .when(F.col("outcome") == "deduplicated", F.lit("deduplicated"))
            .when(F.col("outcome") == "invalid", F.lit("invalid"))
            .otherwise(F.lit("rejected")),
        )
        .withColumn(
            "rejection_reasons",
            F.when(F.col("outcome") == "invalid", F.col("invalid_reasons"))
            .when(F.col("outcome") == "selected", F.array().cast("array<string>"))
            .when(F.col("outcome") == "deduplicated", F.array(F.lit("duplicate")))
            .otherwise(F.array(F.col("outcome"))),
        )
    )


def select_candidates(
    proposals: DataFrame, chunks: DataFrame, segments: DataFrame, words: DataFrame,
    policy: Policy,
) -> DataFrame:
    """One row per proposal, with its terminal outcome and everything recorded about it."""
    assessed = assess(place(proposals, chunks), segments, words, policy)
    return settle(assessed, policy)


def dedup_events(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "deduplicated").select(
        "run_id", "kept_id", F.col("candidate_id").alias("dropped_id"), "iou", "kept_score",
        F.col("total_score").alias("dropped_score"),
    )


def funnel(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts per run; the five outcomes add up to ``proposed``."""
    return outcomes.groupBy(*(keys or ["run_id"])).agg(
        F.count("*").alias("proposed"),
        *[F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES],
    )


def presentation(outcomes: DataFrame) -> DataFrame:
    """Position of every row inside its outcome list of its run.

    Invalid rows follow (chunk, ordinal); all others follow the priority order.
    """
    invalid = F.col("outcome") == "invalid"
    rows = outcomes.withColumns({
        "_score": F.when(invalid, F.lit(0.0)).otherwise(-F.col("total_score")),
        "_chunk": F.when(invalid, F.col("chunk_id")).otherwise(F.lit("")),
        "_at": F.when(invalid, F.floor(F.col("ordinal") / 1024).cast("double"))
        .otherwise(F.col("start")),
        "_head": F.when(invalid, F.lit("")).otherwise(F.substring("candidate_id", 1, 8)),
        "_fine": F.struct(
            F.when(invalid, F.lit("")).otherwise(F.col("candidate_id")).alias("id"),
            F.when(invalid, F.col("ordinal")).otherwise(F.lit(0)).alias("ordinal")),
    })
    return number_by(
        rows, ["run_id", "outcome"], [["_score", "_chunk"], ["_at", "_head"]], "_fine", 1)


def canonical_positions(proposals: DataFrame) -> DataFrame:
    """Arrival-independent 0-based position of every proposal of a run."""
    rows = proposals.withColumn("_block", F.floor(F.col("ordinal") / 1024))
    return number_by(rows, ["run_id"], [["chunk_id"], ["_block"]], "ordinal", 0)


def number_by(rows: DataFrame, keys: list[str], levels: list[list[str]], fine: str, first: int
              ) -> DataFrame:
    """Position of a row by (levels..., fine) without sorting a whole run in one task.

    Per level, the rows of earlier values are counted once per value (combined before the
    shuffle); only rows equal on all levels are sorted together.
    """
    numbered, inside, offset = rows, list(keys), F.lit(first)
    for i, level in enumerate(levels):
        order = Window.partitionBy(*inside).orderBy(*level).rowsBetween(
            Window.unboundedPreceding, -1)
        name = f"_before{i}"
        sizes = rows.groupBy(*inside, *level).count().withColumn(
            name, F.coalesce(F.sum("count").over(order), F.lit(0).cast("bigint"))).drop("count")
        inside = [*inside, *level]
        numbered = numbered.join(sizes, inside)
        offset = offset + F.col(name)
    place = F.row_number().over(Window.partitionBy(*inside).orderBy(fine))
    drop = [c for c in numbered.columns if c.startswith("_")]
    return numbered.withColumn("_n", place).withColumn(
        "position", (offset + F.col("_n") - 1).cast("bigint")).drop("_n", *drop)


def policy_problems() -> Column:
    """Everything wrong with a policy row, in a fixed order."""
    c = F.col
    return reasons([
        ("overlap_not_below_window", c("overlap_seconds") >= c("window_seconds")),
        ("min_duration_not_positive", c("min_duration") <= 0),
        ("min_not_below_max", c("min_duration") >= c("max_duration")),
        ("min_score_out_of_range", (c("min_score") < 0) | (c("min_score") > 100)),
        ("target_above_max", c("target") > c("max_candidates")),
        ("iou_out_of_range", (c("dedupe_iou") < 0) | (c("dedupe_iou") > 1)),
        ("snap_not_positive", c("snap_seconds") <= 0),
    ])


def _differing(policies: dict[str, Policy]) -> set[str]:
    first, *others = policies.values()
    return {f.name for f in dataclasses.fields(Policy)
            if any(getattr(p, f.name) != getattr(first, f.name) for p in others)}


AFTER_SCORING = ("min_score", "dedupe_iou", "max_candidates")


def sweep(assessed: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """Funnels of the same proposals under several policies that differ after scoring; any other
    difference is an error (`sweep_all` takes it).

    One pass: every proposal is repeated once per policy, with the few columns the funnel needs,
    and the key becomes (policy_id, run_id).
    """
    ignored = _differing(policies) - {*AFTER_SCORING, "target"}
    if ignored:
        raise ValueError(f"policies differ before scoring: {', '.join(sorted(ignored))}")
    table = F.array(*[F.struct(
        F.lit(name).alias("policy_id"), F.lit(p.min_score).alias("min_score"),
        F.lit(p.dedupe_iou).alias("dedupe_iou"), F.lit(p.max_candidates).alias("max_candidates"))
        for name, p in policies.items()])
    slim = assessed.select(
        "run_id", "candidate_id", "start", "end", "adjusted_start", "adjusted_end",
        "total_score", "invalid_reasons", F.explode(table).alias("p")).select("*", "p.policy_id")
    keys = ["policy_id", "run_id"]
    own = {name: F.col(f"p.{name}") for name in AFTER_SCORING}
    return funnel(settle(slim, next(iter(policies.values())), keys, own), keys)


#: What a sweep over whole policies gives each row of its own. The target only guides a reviewer.
SWEPT = (*AFTER_SCORING, "window_seconds", "overlap_seconds", "snap_seconds", "min_duration",
         "max_duration", "weights", "target")


def outcomes_by_policy(proposals: DataFrame, segments: DataFrame, words: DataFrame,
                       runs: DataFrame, policies: dict[str, Policy]) -> DataFrame:
    """The outcome of every proposal under every policy, keyed by (policy_id, run_id); each policy's
    rows are those of a run of its own over chunks of its own.

    What policies share is done once: chunks once per (stride, width), the look-up of spoken edges
    in one index at the largest snap, once per (grid, snap). Only then is a proposal repeated for
    every policy, with its durations, weights, threshold and limits."""
    unknown = _differing(policies) - set(SWEPT)
    if unknown:
        raise ValueError(f"policies differ in what is not swept: {', '.join(sorted(unknown))}")
    grids = {(p.stride, p.window_seconds): None for p in policies.values()}
    grids = {f"grid-{i}": grid for i, grid in enumerate(grids)}
    named = {grid: name for name, grid in grids.items()}
    sights = {(named[p.stride, p.window_seconds], float(p.snap_seconds)): None for p in policies.values()}
    chunks = chunk_extents_by_grid(segments, runs, grids).select(
        "grid_id", "run_id", "chunk_id", "window_start", "window_end", "duration",
        F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
    sight = F.array(*[F.struct(F.lit(grid).alias("grid_id"), F.lit(reach).alias("snap_seconds"))
                      for grid, reach in sights])
    placed = proposals.select("*", F.inline(sight)).join(
        chunks, ["grid_id", "run_id", "chunk_id"], "left")
    seen = with_anchors(placed, segments, words, max(p.snap_seconds for p in policies.values()),
                        F.col("snap_seconds"))
    table = F.array(*[F.struct(
        F.lit(name).alias("policy_id"), F.lit(named[p.stride, p.window_seconds]).alias("grid"),
        F.lit(float(p.snap_seconds)).alias("snap"),
        F.lit(float(p.min_duration)).alias("min_duration"),
        F.lit(float(p.max_duration)).alias("max_duration"),
        F.lit(float(p.min_score)).alias("min_score"), F.lit(float(p.dedupe_iou)).alias("dedupe_iou"),
        F.lit(p.max_candidates).alias("max_candidates"),
        F.array(*[F.lit(w).cast("decimal(5,4)") for w in p.weights]).alias("weights"))
        for name, p in policies.items()])
    rows = seen.withColumn("p", F.explode(table)).where(
        (F.col("p.grid") == F.col("grid_id")) & (F.col("p.snap") == F.col("snap_seconds"))
    ).withColumn("policy_id", F.col("p.policy_id"))
    low, high = F.col("p.min_duration"), F.col("p.max_duration")
    weights = [F.get("p.weights", F.lit(i)) for i in range(len(rules.SCORE_NAMES))]
    checked = rows.withColumn("invalid_reasons", validation_reasons(low, high))
    assessed = snap(checked, low, high).withColumn(
        "total_score", weighted_total(weights).cast("double")
    ).drop("start_anchor", "end_anchor", "start_grounded", "end_grounded")
    own = {name: F.col(f"p.{name}") for name in AFTER_SCORING}
    return settle(assessed, next(iter(policies.values())), ["policy_id", "run_id"], own).drop("p")


def sweep_all(proposals: DataFrame, segments: DataFrame, words: DataFrame, runs: DataFrame,
              policies: dict[str, Policy]) -> DataFrame:
    """Funnels of the same proposals under several policies, whatever these differ in."""
    return funnel(outcomes_by_policy(proposals, segments, words, runs, policies),
                  ["policy_id", "run_id"])
