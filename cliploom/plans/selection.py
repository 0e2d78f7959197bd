"""Queries from windows to the shortlist."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import ms, overlap_ratio
from cliploom.operators import chunking as C
from cliploom.operators import dedup as D
from cliploom.operators import proposals as P
from cliploom.operators import selection as S
from cliploom.plans.checks_base import sweep_parts
from cliploom.plans.registry import part, plan
from cliploom.plans.views import VIEW_POLICY, Views


@plan("window_segments", """
SELECT run_id, k AS window_k, idx AS index FROM q_window_members""")
def window_segments(v: Views) -> DataFrame:
    return C.window_segments(v.segments, v.runs, VIEW_POLICY).select(
        "run_id", "window_k", "index")


@plan("chunk_build", """
SELECT run_id, chunk_id, chunk_index, round(ws * 1000)::BIGINT AS window_start_ms,
  round(we * 1000)::BIGINT AS window_end_ms, round(s * 1000)::BIGINT AS start_ms,
  round(e * 1000)::BIGINT AS end_ms, array_to_string(idxs, ',') AS segment_indices, text
FROM q_chunks""")
def chunk_build(v: Views) -> DataFrame:
    return C.build_chunks(v.segments, v.runs, VIEW_POLICY).select(
        "run_id", "chunk_id", "chunk_index", ms(F.col("window_start")).alias("window_start_ms"),
        ms(F.col("window_end")).alias("window_end_ms"), ms(F.col("start")).alias("start_ms"),
        ms(F.col("end")).alias("end_ms"),
        F.array_join(F.col("segment_indices").cast("array<string>"), ",").alias("segment_indices"),
        "text")


@plan("chunk_coverage_stop", """
SELECT run_id, min(k) AS stop_window FROM q_window_cover WHERE covered GROUP BY run_id""")
def chunk_coverage_stop(v: Views) -> DataFrame:
    """First window of a run that repeats its predecessor: one past the last emitted one."""
    members = C.window_segments(v.segments, v.runs, VIEW_POLICY).groupBy("run_id", "window_k").agg(
        F.max("first_k").alias("latest"))
    kept = C.chunk_extents(v.segments, v.runs, VIEW_POLICY).select("run_id", "window_k")
    cut = members.join(kept, ["run_id", "window_k"], "left_anti")
    return cut.groupBy("run_id").agg(F.min("window_k").alias("stop_window"))


@plan("subset_test", """
SELECT run_id, k AS window_k, covered FROM q_window_cover""")
def subset_test(v: Views) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("window_k")
    rows = C.window_segments(v.segments, v.runs, VIEW_POLICY).groupBy("run_id", "window_k").agg(
        F.collect_set("index").alias("now"))
    before = F.lag("now").over(order)
    return rows.withColumn("before", before).select(
        "run_id", "window_k",
        F.coalesce(F.size(F.array_except("now", "before")) == 0, F.lit(False)).alias("covered"))


@plan("chunk_bridge", """
SELECT c.run_id, c.chunk_id, m.idx AS seg_index
FROM q_chunks c JOIN q_window_members m USING (run_id, k)""")
def chunk_bridge(v: Views) -> DataFrame:
    return C.chunk_segments(v.segments, v.runs, VIEW_POLICY)


@plan("proposals_chunks", """
SELECT run_id, candidate_id, ordinal, chunk_id, round(cs * 1000)::BIGINT AS chunk_start_ms,
  round(ce * 1000)::BIGINT AS chunk_end_ms, ps AS start_ms, pe AS end_ms FROM q_proposals""")
def proposals_chunks(v: Views) -> DataFrame:
    return P.place(v.proposals, v.chunks).select(
        "run_id", "candidate_id", "ordinal", "chunk_id",
        ms(F.col("chunk_start")).alias("chunk_start_ms"),
        ms(F.col("chunk_end")).alias("chunk_end_ms"), F.col("p_start_ms").alias("start_ms"),
        F.col("p_end_ms").alias("end_ms"))


def _anchored(v: Views) -> DataFrame:
    return P.with_anchors(
        P.place(v.proposals, v.chunks), v.segments, v.words, VIEW_POLICY.snap_seconds)


@plan("proposal_spoken", """
SELECT p.run_id, p.candidate_id,
  bool_or(a.s - 1e-6 <= p.s AND p.s <= a.e + 1e-6) AS start_spoken,
  bool_or(a.s - 1e-6 <= p.e AND p.e <= a.e + 1e-6) AS end_spoken
FROM q_proposals p JOIN q_chunk_edges a USING (run_id, chunk_id)
GROUP BY p.run_id, p.candidate_id""")
def proposal_spoken(v: Views) -> DataFrame:
    """The interval part alone: a zero reach leaves only 'inside a segment or word'."""
    placed = P.place(v.proposals, v.chunks)
    seen = P.with_anchors(placed, v.segments, v.words, 1e-9)
    return seen.select(
        "run_id", "candidate_id", F.col("start_grounded").alias("start_spoken"),
        F.col("end_grounded").alias("end_spoken"))


@plan("grounding", """
SELECT run_id, candidate_id, sg AS start_grounded, eg AS end_grounded FROM q_checked""")
def grounding(v: Views) -> DataFrame:
    return _anchored(v).select("run_id", "candidate_id", "start_grounded", "end_grounded")


@plan("nearest_anchor", """
SELECT run_id, candidate_id, round(sa.v * 1000)::BIGINT AS start_anchor_ms,
  sa.r::BIGINT AS start_anchor_rank, round(ea.v * 1000)::BIGINT AS end_anchor_ms,
  ea.r::BIGINT AS end_anchor_rank FROM q_checked""")
def nearest_anchor(v: Views) -> DataFrame:
    return _anchored(v).select(
        "run_id", "candidate_id", ms(F.col("start_anchor.at")).alias("start_anchor_ms"),
        F.col("start_anchor.rank").cast("bigint").alias("start_anchor_rank"),
        ms(F.col("end_anchor.at")).alias("end_anchor_ms"),
        F.col("end_anchor.rank").cast("bigint").alias("end_anchor_rank"))


@plan("proposal_validate", "SELECT run_id, candidate_id, reasons FROM q_checked")
def proposal_validate(v: Views) -> DataFrame:
    low, high = F.lit(VIEW_POLICY.min_duration), F.lit(VIEW_POLICY.max_duration)
    return _anchored(v).select(
        "run_id", "candidate_id",
        F.array_join(P.validation_reasons(low, high), ",").alias("reasons"))


@plan("snap_boundary", """
SELECT run_id, candidate_id, round(fs * 1000)::BIGINT AS start_ms,
  round(fe * 1000)::BIGINT AS end_ms, start_kind, end_kind, reverted,
  round((fs - s) * 1000)::BIGINT AS start_delta_ms, round((fe - e) * 1000)::BIGINT AS end_delta_ms
FROM q_snapped WHERE reasons = ''""")
def snap_boundary(v: Views) -> DataFrame:
    rows = v.assessed
    return rows.where(F.size("invalid_reasons") == 0).select(
        "run_id", "candidate_id", ms(F.col("adjusted_start")).alias("start_ms"),
        ms(F.col("adjusted_end")).alias("end_ms"), F.col("start_anchor_kind").alias("start_kind"),
        F.col("end_anchor_kind").alias("end_kind"), "reverted",
        ms(F.col("start_delta")).alias("start_delta_ms"),
        ms(F.col("end_delta")).alias("end_delta_ms"))


@plan("weighted_score", "SELECT run_id, candidate_id, total AS total_score FROM q_snapped")
def weighted_score(v: Views) -> DataFrame:
    return v.proposals.select(
        "run_id", "candidate_id", P.weighted_total().cast("double").alias("total_score"))


@plan("min_score_filter", """
SELECT run_id, candidate_id, total AS total_score FROM q_snapped WHERE total + 1e-6 >= 65""")
def min_score_filter(v: Views) -> DataFrame:
    scored = weighted_score(v)
    return scored.where(S.passes_min_score(F.col("total_score"), F.lit(VIEW_POLICY.min_score)))


def _survivors(v: Views) -> DataFrame:
    """Scored, valid, strong candidates with their final interval."""
    rows = v.assessed
    keep = (F.size("invalid_reasons") == 0) & S.passes_min_score(
        F.col("total_score"), F.lit(VIEW_POLICY.min_score))
    return rows.where(keep).select(
        "run_id", "candidate_id", F.col("adjusted_start").alias("start"),
        F.col("adjusted_end").alias("end"), "total_score")


_IOU_AB = """CASE WHEN least(a.fe, b.fe) - greatest(a.fs, b.fs) <= 0 THEN 0 ELSE
  (least(a.fe, b.fe) - greatest(a.fs, b.fs)) / ((a.fe - a.fs) + (b.fe - b.fs)
   - (least(a.fe, b.fe) - greatest(a.fs, b.fs))) END"""


@plan("pairwise_iou", f"""
SELECT s.run_id, s.candidate_id, count(p.iou) AS partners, max(p.iou) AS best_iou
FROM q_survivors s LEFT JOIN (
  SELECT a.run_id, a.candidate_id, {_IOU_AB} AS iou FROM q_survivors a JOIN q_survivors b
    ON a.run_id = b.run_id AND a.candidate_id <> b.candidate_id WHERE {_IOU_AB} >= 0.25) p
  ON p.run_id = s.run_id AND p.candidate_id = s.candidate_id
GROUP BY s.run_id, s.candidate_id""")
def pairwise_iou(v: Views) -> DataFrame:
    """Partners of every candidate, not the list of all pairs."""
    return D.overlap_partners(_survivors(v), 0.25)


@plan("interval_iou", """
SELECT run_id, candidate_id, CASE WHEN least(e, ce) - greatest(s, cs) <= 0 THEN 0 ELSE
  (least(e, ce) - greatest(s, cs)) / ((e - s) + (ce - cs) - (least(e, ce) - greatest(s, cs))) END
  AS iou FROM q_proposals WHERE e > s""")
def interval_iou(v: Views) -> DataFrame:
    """Overlap of every well-formed proposal with its chunk."""
    ratio = overlap_ratio(F.col("start"), F.col("end"), F.col("chunk_start"), F.col("chunk_end"))
    return P.place(v.proposals, v.chunks).where("end > start").select(
        "run_id", "candidate_id", ratio.alias("iou"))


@plan("greedy_dedup", """
SELECT run_id, kept_id, id AS dropped_id, iou, kept_total AS kept_score, total AS dropped_score
FROM q_dedup_steps WHERE kept_id IS NOT NULL""")
def greedy_dedup(v: Views) -> DataFrame:
    return S.dedup_events(v.outcomes)


@plan("global_rank", """
SELECT run_id, id AS candidate_id, rk AS rank FROM q_ranked WHERE kept_id IS NULL""")
def global_rank(v: Views) -> DataFrame:
    judged = D.greedy_dedup(_survivors(v), VIEW_POLICY.dedupe_iou)
    return judged.where("priority_rank IS NOT NULL").select(
        "run_id", "candidate_id", F.col("priority_rank").alias("rank"))


@plan("top_n_ceiling", """
SELECT run_id, id AS candidate_id, rk AS rank, rk <= 5 AS selected
FROM q_ranked WHERE kept_id IS NULL""")
def top_n_ceiling(v: Views) -> DataFrame:
    return global_rank(v).withColumn("selected", F.col("rank") <= VIEW_POLICY.max_candidates)


@plan("top_n", "SELECT run_id, id AS candidate_id, rk AS rank FROM q_ranked WHERE rk <= 3")
def top_n(v: Views) -> DataFrame:
    return global_rank(v).where(F.col("rank") <= 3)


_OUTCOME_COLUMNS = """run_id, candidate_id, chunk_id, ordinal, outcome, rank,
  round(fs * 1000)::BIGINT AS start_ms, round(fe * 1000)::BIGINT AS end_ms, total AS total_score,
  kept_id, iou"""


@plan("candidate_selection", f"SELECT {_OUTCOME_COLUMNS}, reasons FROM q_outcomes")
def candidate_selection(v: Views) -> DataFrame:
    return S.settle(v.assessed, VIEW_POLICY).select(
        "run_id", "candidate_id", "chunk_id", "ordinal", "outcome", "rank",
        ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), "total_score",
        "kept_id", "iou", F.array_join("invalid_reasons", ",").alias("reasons"))


@plan("funnel_counts", """
SELECT run_id, count(*) AS proposed, count_if(outcome = 'invalid')::BIGINT AS invalid,
  count_if(outcome = 'below_min_score')::BIGINT AS below_min_score,
  count_if(outcome = 'deduplicated')::BIGINT AS deduplicated,
  count_if(outcome = 'not_in_top_n')::BIGINT AS not_in_top_n,
  count_if(outcome = 'selected')::BIGINT AS selected FROM q_outcomes GROUP BY run_id""")
def funnel_counts(v: Views) -> DataFrame:
    return S.funnel(v.outcomes)


@plan("outcome_union", """
SELECT run_id, outcome, (row_number() OVER (PARTITION BY run_id, outcome ORDER BY
    CASE WHEN outcome = 'invalid' THEN 0 ELSE -total END,
    CASE WHEN outcome = 'invalid' THEN 0 ELSE fs END,
    CASE WHEN outcome = 'invalid' THEN chunk_id ELSE candidate_id END,
    CASE WHEN outcome = 'invalid' THEN ordinal ELSE 0 END))::BIGINT AS position, candidate_id
FROM q_outcomes""")
def outcome_union(v: Views) -> DataFrame:
    return S.presentation(v.outcomes).select("run_id", "outcome", "position", "candidate_id")


@plan("canonical_order", """
SELECT run_id, candidate_id, (row_number() OVER (PARTITION BY run_id
  ORDER BY chunk_id, ordinal) - 1)::BIGINT AS position FROM q_proposals""")
def canonical_order(v: Views) -> DataFrame:
    """Arrival-independent position: proposals before this chunk plus those before it inside."""
    return S.canonical_positions(v.proposals).select("run_id", "candidate_id", "position")


@plan("policy_validate", """
SELECT policy_id, count(*) AS n, array_to_string(list_filter([
  CASE WHEN overlap >= win THEN 'overlap_not_below_window' END,
  CASE WHEN min_d <= 0 THEN 'min_duration_not_positive' END,
  CASE WHEN min_d >= max_d THEN 'min_not_below_max' END,
  CASE WHEN score < 0 OR score > 100 THEN 'min_score_out_of_range' END,
  CASE WHEN target > cap THEN 'target_above_max' END,
  CASE WHEN iou < 0 OR iou > 1 THEN 'iou_out_of_range' END,
  CASE WHEN snap <= 0 THEN 'snap_not_positive' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT event_id % 64 AS policy_id, 300 + event_id % 64 AS win, (event_id % 8) * 50 AS overlap,
   (event_id % 4) * 10 AS min_d, 20 + (event_id % 16) AS max_d, (event_id % 32) * 4 - 4 AS score,
   event_id % 16 AS target, 4 + event_id % 8 AS cap, (event_id % 32) / 25.0::DOUBLE AS iou,
   (event_id % 64) - 2 AS snap FROM events)
GROUP BY ALL""")
def policy_validate(v: Views) -> DataFrame:
    e = F.col("event_id")
    table = v.table("events").select(
        (e % 64).alias("policy_id"), (300 + e % 64).alias("window_seconds"),
        ((e % 8) * 50).alias("overlap_seconds"), ((e % 4) * 10).alias("min_duration"),
        (20 + e % 16).alias("max_duration"), ((e % 32) * 4 - 4).alias("min_score"),
        (e % 16).alias("target"), (4 + e % 8).alias("max_candidates"),
        ((e % 32) / F.lit(25.0)).alias("dedupe_iou"), ((e % 64) - 2).alias("snap_seconds"))
    problems = S.policy_problems()
    return table.withColumn("problems", F.array_join(problems, ",")).groupBy(
        "policy_id", "problems").agg(F.count("*").alias("n"))


part("q_sweep_policy", """
SELECT * FROM (VALUES ('base', 65, 0.6::DOUBLE, 5), ('strict', 75, 0.6::DOUBLE, 5),
  ('loose_overlap', 65, 0.8::DOUBLE, 5), ('short_list', 65, 0.6::DOUBLE, 2))
  t(policy_id, min_score, iou_limit, cap)""")
part("q_sweep_rows", """
SELECT p.*, w.policy_id, w.min_score, w.iou_limit, w.cap FROM q_snapped p, q_sweep_policy w""")
part("q_sweep_in", """
SELECT * FROM q_sweep_rows WHERE reasons = '' AND total + 1e-6 >= min_score""")


sweep_parts()


@plan("policy_sweep", """
SELECT r.policy_id, r.run_id, count(*) AS proposed, count_if(reasons <> '')::BIGINT AS invalid,
  count_if(reasons = '' AND r.total + 1e-6 < min_score)::BIGINT AS below_min_score,
  coalesce(count_if(k.kept_id IS NOT NULL), 0)::BIGINT AS deduplicated,
  coalesce(count_if(k.rk > cap), 0)::BIGINT AS not_in_top_n,
  coalesce(count_if(k.rk <= cap), 0)::BIGINT AS selected
FROM q_sweep_rows r LEFT JOIN (
  SELECT policy_id, run_id, id, kept_id, CASE WHEN kept_id IS NULL THEN row_number() OVER (
    PARTITION BY policy_id, run_id, kept_id IS NULL ORDER BY total DESC, s, id) END AS rk
  FROM q_sweep_steps) k
  ON k.policy_id = r.policy_id AND k.run_id = r.run_id AND k.id = r.candidate_id
GROUP BY r.policy_id, r.run_id""")
def policy_sweep(v: Views) -> DataFrame:
    policies = {
        "base": rules.Policy(min_score=65, dedupe_iou=0.6, max_candidates=5),
        "strict": rules.Policy(min_score=75, dedupe_iou=0.6, max_candidates=5),
        "loose_overlap": rules.Policy(min_score=65, dedupe_iou=0.8, max_candidates=5),
        "short_list": rules.Policy(min_score=65, dedupe_iou=0.6, max_candidates=2),
    }
    return S.sweep(v.assessed, policies)


@plan("policy_sweep_windows")
def policy_sweep_windows(v: Views) -> DataFrame:
    """Policies that differ in windows, overlap, snap, durations and weights; tests compare each
    with a run of its own."""
    change = functools.partial(dataclasses.replace, VIEW_POLICY)
    return S.sweep_all(v.proposals, v.segments, v.words, v.runs, {
        "base": VIEW_POLICY, "wide": change(window_seconds=240.0),
        "overlapping": change(overlap_seconds=60.0), "loose_snap": change(snap_seconds=5.0),
        "short_clips": change(min_duration=10.0, max_duration=45.0),
        "hook_first": change(weights=("0.50", "0.10", "0.10", "0.10", "0.10", "0.10"), min_score=75),
    })
