"""Queries over human decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import ms
from cliploom.operators import proposals as P
from cliploom.operators import review as V
from cliploom.operators.ledger import admitted, ledger
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views

_REASONS = "[" + ", ".join(f"'{r}'" for r in rules.EDITORIAL_REASONS) + "]"
part("q_decisions", f"""
SELECT run_id, candidate_id, rank, h, category, duration_ms, decision, fs AS os, fe AS oe,
  CASE WHEN decision = 'rejected' THEN NULL WHEN decision = 'edited'
    THEN greatest(0, round(fs * 1000)::BIGINT - 1500) / 1000.0::DOUBLE ELSE fs END AS ns,
  CASE WHEN decision = 'rejected' THEN NULL WHEN decision = 'edited'
    THEN least(duration_ms, round(fe * 1000)::BIGINT + 2000) / 1000.0::DOUBLE ELSE fe END AS ne,
  CASE WHEN decision = 'rejected' THEN {_REASONS}[(h % 9) + 1] END AS reason,
  CASE WHEN decision = 'rejected' AND (h % 9 = 8 OR h % 4 = 0) THEN 'note' END AS detail, total
FROM (SELECT s.*, r.duration_ms, CASE WHEN h % 10 <= 5 OR h % 10 = 9 THEN 'approved'
        WHEN h % 10 = 6 THEN 'edited' ELSE 'rejected' END AS decision
      FROM q_selected s JOIN q_runs r USING (run_id)
      WHERE h % 10 <> 9 OR run_id % 7 <> 0)""")
part("q_faulty0", """
SELECT *, (h // 10) % 17 AS g FROM q_decisions
UNION ALL SELECT *, (h // 10) % 17 AS g FROM q_decisions WHERE (h // 10) % 17 = 11""")
part("q_faulty", """
SELECT CASE WHEN g = 15 THEN -1 - q_faulty0.run_id ELSE q_faulty0.run_id END AS run_id,
  h, g, decision, duration_ms,
  CASE WHEN g = 9 THEN candidate_id || 'x' ELSE candidate_id END AS candidate_id,
  CASE WHEN g = 10 THEN os + 0.25 ELSE os END AS os,
  CASE WHEN g = 6 THEN os WHEN g = 12 THEN oe + 0.25 ELSE oe END AS oe,
  CASE WHEN g = 1 THEN os WHEN g = 13 AND decision <> 'rejected' THEN -4 ELSE ns END AS ns,
  CASE WHEN g = 0 THEN ne + 0.5 WHEN g = 1 THEN oe WHEN g = 7
    THEN ne + duration_ms / 1000.0::DOUBLE ELSE ne END AS ne,
  CASE WHEN g = 2 AND decision = 'rejected' THEN 'other' WHEN g = 3 THEN NULL
    WHEN g = 14 THEN 'weak_hook' ELSE reason END
    AS reason,
  CASE WHEN g = 2 THEN ' ' WHEN g = 3 THEN 'note' WHEN g = 8 THEN repeat('d', 2001) ELSE detail END
    AS detail,
  CASE WHEN g IN (4, 5) THEN false ELSE true END AS utc,
  CASE WHEN q_faulty0.run_id % 31 = 0 THEN 'other' ELSE 'print' || q_faulty0.run_id END
    AS fingerprint,
  CASE WHEN q_faulty0.run_id % 37 = 0 THEN duration_ms + 1000 ELSE duration_ms END / 1000.0::DOUBLE AS dur
FROM q_faulty0""")
part("q_targets", """
SELECT run_id, candidate_id, rank, h, category, decision, os, oe, total,
  CASE WHEN decision = 'edited' THEN ns ELSE os END AS s,
  CASE WHEN decision = 'edited' THEN ne ELSE oe END AS e
FROM q_decisions WHERE decision <> 'rejected' AND run_id NOT IN (
  SELECT s.run_id FROM q_selected s LEFT JOIN q_decisions d USING (run_id, candidate_id)
  WHERE d.decision IS NULL)""")

_MOVED = "(abs(ns - os) > 1e-6 OR abs(ne - oe) > 1e-6)"


@plan("decision_validate", f"""
SELECT f.run_id, f.candidate_id, f.decision, count(*) AS copies, array_to_string(list_filter([
  CASE WHEN g = 15 THEN 'unknown_run' END,
  CASE WHEN NOT utc THEN 'timestamp_not_utc' END,
  CASE WHEN os < 0 OR oe <= os THEN 'original_not_ordered' END,
  CASE WHEN decision IN ('approved', 'edited') AND (ns IS NULL OR ne IS NULL)
    THEN 'interval_missing' END,
  CASE WHEN ns < 0 OR ne < 0 THEN 'final_negative' END,
  CASE WHEN decision = 'approved' AND {_MOVED} THEN 'approved_moved' END,
  CASE WHEN decision = 'edited' AND ne <= ns THEN 'edited_not_ordered' END,
  CASE WHEN decision = 'edited' AND NOT {_MOVED} THEN 'edited_not_moved' END,
  CASE WHEN decision = 'rejected' AND (ns IS NOT NULL OR ne IS NOT NULL)
    THEN 'rejected_with_interval' END,
  CASE WHEN decision <> 'rejected' AND (reason IS NOT NULL OR detail IS NOT NULL)
    THEN 'reason_without_rejection' END,
  CASE WHEN detail IS NOT NULL AND reason IS NULL THEN 'detail_without_reason' END,
  CASE WHEN reason = 'other' AND trim(coalesce(detail, '')) = '' THEN 'other_needs_detail' END,
  CASE WHEN length(detail) > 2000 THEN 'detail_too_long' END,
  CASE WHEN g <> 15 AND ne > duration_ms / 1000.0::DOUBLE + 1e-6 THEN 'ends_beyond_source' END,
  CASE WHEN n.n > 1 THEN 'repeated_candidate' END], lambda x: x IS NOT NULL), ',') AS problems
FROM q_faulty f JOIN (SELECT run_id, candidate_id, count(*) AS n FROM q_faulty GROUP BY ALL) n
  USING (run_id, candidate_id)
GROUP BY ALL""")
def decision_validate(v: Views) -> DataFrame:
    rows = V.decision_problems(v.faulty_decisions, v.runs)
    return rows.withColumn("problems", F.array_join("problems", ",")).groupBy(
        "run_id", "candidate_id", "decision", "problems").agg(F.count("*").alias("copies"))


@plan("orphan_decisions", """
SELECT DISTINCT f.run_id, f.candidate_id,
  CASE WHEN g = 15 THEN 'unknown_run' WHEN fingerprint <> 'print' || f.run_id THEN 'other_analysis'
    WHEN abs(dur - duration_ms / 1000.0::DOUBLE) > 1e-6 THEN 'other_duration'
    WHEN s.fs IS NULL THEN 'not_selected'
    WHEN abs(f.os - s.fs) > 1e-6 THEN 'original_start_differs'
    WHEN abs(f.oe - s.fe) > 1e-6 THEN 'original_end_differs' END AS problem
FROM q_faulty f LEFT JOIN q_selected s USING (run_id, candidate_id)""")
def orphan_decisions(v: Views) -> DataFrame:
    return V.coherence_problems(v.faulty_decisions, v.selected, v.run_prints).select(
        "run_id", "candidate_id", "problem").distinct()


@plan("clip_targets", """
SELECT run_id, candidate_id, rank, decision, round(os * 1000)::BIGINT AS original_start_ms,
  round(oe * 1000)::BIGINT AS original_end_ms, round(s * 1000)::BIGINT AS start_ms,
  round(e * 1000)::BIGINT AS end_ms FROM q_targets""")
def clip_targets(v: Views) -> DataFrame:
    return v.targets.select(
        "run_id", "candidate_id", "rank", "decision",
        ms(F.col("original_start")).alias("original_start_ms"),
        ms(F.col("original_end")).alias("original_end_ms"), ms(F.col("start")).alias("start_ms"),
        ms(F.col("end")).alias("end_ms"))


@plan("rank_order", """
SELECT run_id, rank, candidate_id, (row_number() OVER (PARTITION BY run_id ORDER BY rank))::BIGINT
  AS position FROM q_targets""")
def rank_order(v: Views) -> DataFrame:
    """Clips follow candidate ranks, whatever order the decisions were taken in."""
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy("rank")
    return v.targets.select(
        "run_id", "rank", "candidate_id",
        F.row_number().over(order).cast("bigint").alias("position"))


@plan("pending_candidates", """
SELECT s.run_id, s.candidate_id, s.rank FROM q_selected s
LEFT JOIN q_decisions d USING (run_id, candidate_id) WHERE d.decision IS NULL""")
def pending_candidates(v: Views) -> DataFrame:
    return V.pending(v.selected, v.decisions).select("run_id", "candidate_id", "rank")


@plan("decision_counts", """
SELECT run_id, coalesce(count_if(decision = 'approved'), 0)::BIGINT AS approved,
  coalesce(count_if(decision = 'rejected'), 0)::BIGINT AS rejected,
  coalesce(count_if(decision = 'edited'), 0)::BIGINT AS edited
FROM q_runs LEFT JOIN q_decisions USING (run_id) GROUP BY run_id""")
def decision_counts(v: Views) -> DataFrame:
    return V.decision_counts(v.runs, v.decisions)


part("q_decision_log", """
SELECT user_id AS run_id, (props ->> '$.k')::BIGINT AS candidate_id, ts, event_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'approved'
       WHEN event_type IN ('click', 'signup') THEN 'edited' ELSE 'rejected' END AS decision
FROM events""")


@plan("latest_decision", """
SELECT run_id, candidate_id, decision, event_id FROM q_decision_log
QUALIFY row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_decision(v: Views) -> DataFrame:
    return V.latest_decision(v.decision_log)


part("q_answers", """
SELECT run_id, CASE WHEN (run_id + chunk_index) % 41 = 0 THEN 'chunk_9999'
    WHEN (run_id + chunk_index) % 43 = 1 THEN 'chunk_0000' ELSE chunk_id END AS chunk_id,
  CASE WHEN (run_id + chunk_index) % 37 = 2 THEN 'other' WHEN chunk_index % 3 = 0 THEN NULL
    ELSE 'm' || run_id % 3 END AS model FROM q_chunks""")
part("q_refusals", """
SELECT f.run_id, 'review' AS operator, 2 AS step, CASE WHEN s.fs IS NULL THEN 2 END AS rank
FROM q_faulty f LEFT JOIN q_selected s USING (run_id, candidate_id) WHERE s.fs IS NULL
UNION ALL SELECT f.run_id, 'review', 2, 3 FROM q_faulty f JOIN q_selected s USING (run_id, candidate_id)
WHERE abs(f.os - s.fs) > 1e-6
UNION ALL SELECT f.run_id, 'review', 2, 4 FROM q_faulty f JOIN q_selected s USING (run_id, candidate_id)
WHERE abs(f.oe - s.fe) > 1e-6
UNION ALL SELECT run_id, 'review', 2, 1 FROM q_faulty GROUP BY run_id, candidate_id HAVING count(*) > 1
UNION ALL SELECT run_id, 'review', 2, 5 FROM q_selected
WHERE (run_id, candidate_id) NOT IN (SELECT (run_id, candidate_id) FROM q_faulty)
UNION ALL SELECT run_id, 'analysis', 1, 1 FROM q_answers
WHERE (run_id, chunk_id) NOT IN (SELECT (run_id, chunk_id) FROM q_chunks)
UNION ALL SELECT a.run_id, 'analysis', 1, 2 FROM q_answers a JOIN (
  SELECT run_id, chunk_id FROM q_answers GROUP BY ALL HAVING count(*) > 1) t USING (run_id, chunk_id)
UNION ALL SELECT run_id, 'analysis', 1, 3 FROM q_answers WHERE model <> 'm' || run_id % 3""")


@plan("run_refusals", f"""
SELECT run_id, first.operator AS operator, CASE first.operator
  WHEN 'analysis' THEN {list(P.ANSWER_PROBLEMS)}[first.rank]
  ELSE {list(V.TARGET_PROBLEMS)}[first.rank] END AS problem, n AS n_problems
FROM (SELECT run_id, min({{'step': step, 'rank': rank, 'operator': operator}}) AS first, count(*) AS n
  FROM q_refusals GROUP BY run_id)""")
def run_refusals(v: Views) -> DataFrame:
    """Runs that an analysis or a review cannot stand for, with the first thing wrong."""
    return ledger({
        "analysis": P.answer_problems(answers(v), v.chunks, models(v)),
        "review": V.target_problems(v.selected, v.faulty_decisions)})


def answers(v: Views) -> DataFrame:
    """Answers to chunks; some name another chunk or another model."""
    c = F.col
    at = c("run_id") + c("chunk_index")
    return v.chunks.select(
        "run_id", F.when(at % 41 == 0, F.lit("chunk_9999")).when(at % 43 == 1, F.lit("chunk_0000"))
        .otherwise(c("chunk_id")).alias("chunk_id"),
        F.when(at % 37 == 2, F.lit("other")).when(c("chunk_index") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("m"), (c("run_id") % 3).cast("string"))).alias("model"))


def models(v: Views) -> DataFrame:
    return v.runs.select("run_id", F.concat(
        F.lit("m"), (F.col("run_id") % 3).cast("string")).alias("model"))


@plan("admitted_targets", """
SELECT t.run_id, candidate_id, rank FROM q_targets t WHERE t.run_id NOT IN (
  SELECT run_id FROM q_refusals WHERE step = 1)""")
def admitted_targets(v: Views) -> DataFrame:
    """Clips of runs that nothing before has refused."""
    refused = ledger({"analysis": P.answer_problems(answers(v), v.chunks, models(v))})
    return admitted(v.targets, refused).select("run_id", "candidate_id", "rank")
