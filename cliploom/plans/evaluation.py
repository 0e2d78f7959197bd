"""Queries over acceptance, boundaries and human reference clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import ms
from cliploom.operators import evaluate as E
from cliploom.operators import review as V
from cliploom.operators.selection import funnel
from cliploom.plans.checks_base import recipe
from cliploom.plans.lineage import stage_records
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views, seconds


@plan("boundary_stats", """
SELECT run_id, count(*) AS candidates,
  (count_if(a > 0) + count_if(b > 0))::BIGINT AS moved_boundaries,
  sum(a + b)::DOUBLE / (count(*) * 2) AS mean_abs_ms, count_if(reverted)::BIGINT AS reverted,
  (count_if(start_kind = 'segment_start') + count_if(end_kind = 'segment_start'))::BIGINT
    AS anchor_segment_start,
  (count_if(start_kind = 'word_start') + count_if(end_kind = 'word_start'))::BIGINT
    AS anchor_word_start,
  (count_if(start_kind = 'segment_end') + count_if(end_kind = 'segment_end'))::BIGINT
    AS anchor_segment_end,
  (count_if(start_kind = 'word_end') + count_if(end_kind = 'word_end'))::BIGINT AS anchor_word_end,
  (count_if(start_kind = 'unchanged') + count_if(end_kind = 'unchanged'))::BIGINT
    AS anchor_unchanged
FROM (SELECT *, abs(round((fs - s) * 1000)::BIGINT) AS a, abs(round((fe - e) * 1000)::BIGINT) AS b
      FROM q_snapped WHERE reasons = '') GROUP BY run_id""")
def boundary_stats(v: Views) -> DataFrame:
    return E.boundary_stats(v.assessed.where(F.size("invalid_reasons") == 0))


@plan("acceptance_rates", """
SELECT run_id, category, GROUPING_ID(run_id, category)::BIGINT AS level, count(*) AS presented,
  count_if(decision = 'approved')::BIGINT AS approved,
  count_if(decision = 'edited')::BIGINT AS edited,
  count_if(decision = 'rejected')::BIGINT AS rejected,
  count_if(decision = 'approved')::DOUBLE / count(*) AS acceptance_rate,
  count_if(decision = 'edited')::DOUBLE / count(*) AS edit_rate
FROM q_decisions GROUP BY GROUPING SETS ((run_id, category), (run_id), (category), ())""")
def acceptance_rates(v: Views) -> DataFrame:
    return E.acceptance_rates(v.decisions)


@plan("rejection_distribution", """
SELECT reason, count(*) AS n, 'editorial' AS vocabulary FROM q_decisions
WHERE decision = 'rejected' GROUP BY reason
UNION ALL SELECT reason, count(*), 'rules' FROM (
  SELECT unnest(CASE outcome WHEN 'invalid' THEN string_split(reasons, ',')
    WHEN 'deduplicated' THEN ['duplicate'] WHEN 'selected' THEN [] ELSE [outcome] END) AS reason
  FROM q_outcomes) GROUP BY reason""")
def rejection_distribution(v: Views) -> DataFrame:
    return E.rejection_distribution(v.outcomes, v.decisions)


part("q_ref0", recipe("q_chunks", "[100, 101, 102]"))
part("q_reference", """
SELECT run_id, chunk_index * 1000 + ordinal AS clip_no, ps / 1000.0::DOUBLE AS s, pe / 1000.0::DOUBLE AS e FROM q_ref0
WHERE ordinal - 100 < run_id % 3 + 1 AND ps >= 0 AND pe > ps
UNION ALL
SELECT run_id, rank AS clip_no, (round(fs * 1000)::BIGINT + (h % 7) * 1000) / 1000.0::DOUBLE,
  (round(fe * 1000)::BIGINT - (h % 5) * 500) / 1000.0::DOUBLE
FROM q_selected WHERE h % 2 = 0""")
part("q_pairs", """
SELECT c.run_id, c.candidate_id, g.clip_no,
  (least(c.fe, g.e) - greatest(c.fs, g.s)) / ((c.fe - c.fs) + (g.e - g.s)
    - (least(c.fe, g.e) - greatest(c.fs, g.s))) AS iou,
  round(abs(c.fs - g.s) * 1000)::BIGINT AS start_error_ms,
  round(abs(c.fe - g.e) * 1000)::BIGINT AS end_error_ms
FROM q_selected c JOIN q_reference g
  ON g.run_id = c.run_id AND least(c.fe, g.e) - greatest(c.fs, g.s) > 0""")
part("q_matches", """
SELECT *, row_number() OVER (PARTITION BY run_id, clip_no
    ORDER BY iou DESC, candidate_id DESC) = 1 AS best_for_clip,
  row_number() OVER (PARTITION BY run_id, candidate_id
    ORDER BY iou DESC, clip_no DESC) = 1 AS best_for_candidate
FROM q_pairs WHERE iou > 0.5""")


def reference_clips(v: Views) -> DataFrame:
    """Human clips: some by the recipe over every chunk, some near what was selected."""
    made = v._proposal_ms(v.chunks, F.explode(F.expr("sequence(100L, 102L)"))).where(
        (F.col("ordinal") - 100 < F.col("run_id") % 3 + 1) & (F.col("p_start_ms") >= 0)
        & (F.col("p_end_ms") > F.col("p_start_ms"))
    ).select("run_id", (F.col("chunk_index") * 1000 + F.col("ordinal")).alias("clip_no"), seconds("p_start_ms").alias("start"),
             seconds("p_end_ms").alias("end"))
    h = F.col("h")
    near = v.selected.where(h % 2 == 0).select(
        "run_id", F.col("rank").alias("clip_no"),
        seconds(ms(F.col("start")) + (h % 7) * 1000).alias("start"),
        seconds(ms(F.col("end")) - (h % 5) * 500).alias("end"))
    return made.unionByName(near)


@plan("ground_truth_match", """
SELECT run_id, candidate_id, clip_no, iou, start_error_ms, end_error_ms, best_for_clip,
  best_for_candidate FROM q_matches WHERE best_for_clip OR best_for_candidate""")
def ground_truth_match(v: Views) -> DataFrame:
    return E.match_reference(v.selected, reference_clips(v))


@plan("evaluation_metrics", """
SELECT run_id, coalesce(p.n, 0)::BIGINT AS presented, coalesce(w.n, 0)::BIGINT AS clips,
  coalesce(o.n, 0)::DOUBLE / p.n AS match_rate, coalesce(b.n, 0)::DOUBLE / w.n AS recall,
  b.iou_sum::DOUBLE / b.n / 1000000 AS mean_iou, b.ss::DOUBLE / b.n AS mean_start_error_ms,
  b.es::DOUBLE / b.n AS mean_end_error_ms
FROM (SELECT run_id, count(*) AS n FROM q_selected GROUP BY run_id) p
FULL JOIN (SELECT run_id, count(*) AS n FROM q_reference GROUP BY run_id) w USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n FROM q_matches WHERE best_for_candidate GROUP BY run_id) o
  USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS n, sum(round(iou * 1000000)::BIGINT) AS iou_sum,
    sum(start_error_ms) AS ss, sum(end_error_ms) AS es
  FROM q_matches WHERE best_for_clip GROUP BY run_id) b USING (run_id)""")
def evaluation_metrics(v: Views) -> DataFrame:
    reference = reference_clips(v)
    return E.evaluation_metrics(
        v.selected, reference, E.match_reference(v.selected, reference))


@plan("boundary_error", """
SELECT category, count(*) AS edited, sum(a)::DOUBLE / count(*) AS mean_start_ms,
  sum(b)::DOUBLE / count(*) AS mean_end_ms, quantile_cont(a, 0.5)::DOUBLE AS median_start_ms,
  quantile_cont(b, 0.5)::DOUBLE AS median_end_ms
FROM (SELECT category, abs(round(ns * 1000)::BIGINT - round(os * 1000)::BIGINT) AS a,
        abs(round(ne * 1000)::BIGINT - round(oe * 1000)::BIGINT) AS b
      FROM q_decisions WHERE decision = 'edited') GROUP BY category""")
def boundary_error(v: Views) -> DataFrame:
    return E.boundary_error(v.decisions)


_TIMED = list(zip(rules.STAGES, rules.STAGES[1:], strict=False))


@plan("run_report", f"""
SELECT r.run_id, r.duration_ms, coalesce(f.n, 0)::BIGINT AS proposed, coalesce(f.v, 0)::BIGINT AS valid,
  coalesce(f.s, 0)::BIGINT AS selected, coalesce(f.u, 0)::BIGINT AS deduplicated, coalesce(d.p, 0)::BIGINT AS presented,
  coalesce(d.a, 0)::BIGINT AS approved, coalesce(d.e, 0)::BIGINT AS edited,
  coalesce(d.j, 0)::BIGINT AS rejected, d.a::DOUBLE / nullif(d.p, 0) AS acceptance_rate,
  {", ".join(f"t.{later}_seconds" for _, later in _TIMED)}
FROM q_runs r
LEFT JOIN (SELECT run_id, count(*) AS n, count_if(outcome <> 'invalid') AS v,
    count_if(outcome = 'selected') AS s, count_if(outcome = 'deduplicated') AS u FROM q_outcomes GROUP BY run_id) f USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS p, count_if(decision = 'approved') AS a,
    count_if(decision = 'edited') AS e, count_if(decision = 'rejected') AS j
  FROM q_decisions GROUP BY run_id) d USING (run_id)
LEFT JOIN (SELECT run_id,
    {", ".join(f"max(completed_at) FILTER (WHERE stage = '{later}')"
               f" - max(completed_at) FILTER (WHERE stage = '{stage}') AS {later}_seconds"
               for stage, later in _TIMED)}
  FROM q_records GROUP BY run_id) t USING (run_id)""")
def run_report(v: Views) -> DataFrame:
    def at(stage: str):
        return F.max(F.when(F.col("stage") == stage, F.col("completed_at")))

    timings = stage_records(v).groupBy("run_id").agg(
        *[(at(later) - at(stage)).alias(f"{later}_seconds") for stage, later in _TIMED])
    report = E.run_report(
        v.runs, funnel(v.outcomes), V.decision_counts(v.runs, v.decisions), timings)
    zero = F.lit(0).cast("bigint")
    return report.select(
        "run_id", ms(F.col("duration")).alias("duration_ms"),
        *[F.coalesce(n, zero).alias(n) for n in (
            "proposed", "valid", "selected", "deduplicated", "presented", "approved", "edited",
            "rejected")],
        "acceptance_rate", *[f"{later}_seconds" for _, later in _TIMED])
