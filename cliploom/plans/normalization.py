"""Queries over raw transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.functions.columns import ms
from cliploom.operators import normalize as N
from cliploom.operators.scans import dense_number, running_before
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views

_NOT_REFUSED = "run_id NOT IN (SELECT run_id FROM q_refused)"


@plan("finite_guard", """
SELECT * FROM (SELECT run_id,
  ((NOT isfinite(duration))::INT + coalesce(NOT isfinite(declared), false)::INT
   + (NOT isfinite(language_probability))::INT)::BIGINT AS run_values,
  coalesce((SELECT sum((NOT isfinite(s))::INT + (NOT isfinite(e))::INT) FROM q_raw_segments g
    WHERE g.run_id = r.run_id), 0)::BIGINT AS segment_values,
  coalesce((SELECT sum((NOT isfinite(s))::INT + (NOT isfinite(e))::INT
      + coalesce(NOT isfinite(prob), false)::INT) FROM q_raw_words w
    WHERE w.run_id = r.run_id), 0)::BIGINT AS word_values
FROM q_raw_runs r) WHERE run_values + segment_values + word_values > 0""")
def finite_guard(v: Views) -> DataFrame:
    return N.finite_problems(v.raw_runs, v.raw_segments, v.raw_words)


@plan("duration_gate", """
SELECT run_id, coalesce(problem, 'ok') AS verdict FROM q_gate""")
def duration_gate(v: Views) -> DataFrame:
    return N.duration_gate(v.raw_runs).select(
        "run_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


@plan("segment_clamp", """
SELECT run_id, seg_pos, round(cs * 1000)::BIGINT AS start_ms, round(ce * 1000)::BIGINT AS end_ms,
  len(notes)::BIGINT AS corrections
FROM q_cseg WHERE run_id NOT IN (SELECT run_id FROM q_cseg WHERE problem IS NOT NULL)""")
def segment_clamp(v: Views) -> DataFrame:
    rows = v.clamped_segments
    bad = rows.where("problem IS NOT NULL").select("run_id").distinct()
    return rows.join(bad, "run_id", "left_anti").select(
        "run_id", "seg_pos", ms(F.col("start")).alias("start_ms"),
        ms(F.col("end")).alias("end_ms"), F.size("notes").cast("bigint").alias("corrections"))


@plan("word_clamp", """
SELECT run_id, seg_pos, word_pos, round(cs * 1000)::BIGINT AS start_ms,
  round(ce * 1000)::BIGINT AS end_ms, len(notes)::BIGINT AS corrections
FROM q_cword WHERE run_id NOT IN (SELECT run_id FROM q_refused)""")
def word_clamp(v: Views) -> DataFrame:
    return v.clamped_words.join(v.refused.select("run_id"), "run_id", "left_anti").select(
        "run_id", "seg_pos", "word_pos", ms(F.col("start")).alias("start_ms"),
        ms(F.col("end")).alias("end_ms"), F.size("notes").cast("bigint").alias("corrections"))


@plan("normalization_refusals", """
SELECT run_id, f.a::BIGINT AS seg_pos, f.b::BIGINT AS part, f.c AS problem FROM q_refused""")
def normalization_refusals(v: Views) -> DataFrame:
    return v.refused


@plan("segment_text_cleanup", f"""
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY seg_pos) - 1)::BIGINT AS index,
  seg_pos, round(cs * 1000)::BIGINT AS start_ms, round(ce * 1000)::BIGINT AS end_ms, clean AS text
FROM q_cseg WHERE clean <> '' AND {_NOT_REFUSED}""")
def segment_text_cleanup(v: Views) -> DataFrame:
    return N.normalized_segments(v.clamped_segments, v.refused).select(
        "run_id", "index", "seg_pos", ms(F.col("start")).alias("start_ms"),
        ms(F.col("end")).alias("end_ms"), "text")


part("q_notes", """
SELECT run_id, seg_pos, 0 AS part, i, 'segment ' || seg_pos || n AS note,
  n <> ': dropped, no text' AS seg_clamp, false AS word_clamp FROM (
  SELECT run_id, seg_pos, unnest(all_notes) AS n, generate_subscripts(all_notes, 1) AS i FROM (
    SELECT *, CASE WHEN clean = '' THEN list_append(notes, ': dropped, no text') ELSE notes END
      AS all_notes FROM q_cseg))
UNION ALL
SELECT run_id, seg_pos, word_pos + 1, i, 'segment ' || seg_pos || ' word ' || word_pos || n,
  false, true FROM (
  SELECT run_id, seg_pos, word_pos, unnest(notes) AS n, generate_subscripts(notes, 1) AS i
  FROM q_cword)""")


@plan("normalization_report", """
SELECT r.run_id,
  coalesce(count_if(n.seg_clamp), 0)::BIGINT AS clamped_segment_bounds,
  coalesce(count_if(n.word_clamp), 0)::BIGINT AS clamped_word_bounds,
  coalesce(count_if(NOT n.seg_clamp AND NOT n.word_clamp), 0)::BIGINT AS dropped_empty_segments,
  coalesce(string_agg(n.note, '; ' ORDER BY k) FILTER (WHERE k <= 20), '')
    || CASE WHEN count(n.note) > 20 THEN '; further normalizations omitted' ELSE '' END AS notes
FROM q_raw_runs r LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seg_pos, part, i) AS k FROM q_notes) n
  USING (run_id)
WHERE r.run_id NOT IN (SELECT run_id FROM q_refused) GROUP BY r.run_id""")
def normalization_report(v: Views) -> DataFrame:
    return N.report(v.clamped_segments, v.marked_words, v.raw_runs, v.refused).withColumn(
        "notes", F.array_join("notes", "; "))


@plan("transcription_metrics", """
SELECT run_id,
  (SELECT count(*) FROM q_cseg g WHERE g.run_id = r.run_id AND g.clean <> '') AS segment_count,
  (SELECT count(*) FROM q_cword w WHERE w.run_id = r.run_id) AS word_count,
  round(processing_seconds / duration, 4) AS real_time_factor
FROM q_raw_runs r WHERE run_id NOT IN (SELECT run_id FROM q_refused)""")
def transcription_metrics(v: Views) -> DataFrame:
    return N.metrics(
        v.clamped_segments.where(~F.col("dropped")), v.clamped_words, v.raw_runs, v.refused)


@plan("running_floor", """
SELECT run_id, seg_pos, round(least(greatest(0, coalesce(max(s) OVER (PARTITION BY run_id
  ORDER BY seg_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), duration) * 1000)::BIGINT
  AS floor_ms FROM (
  SELECT g.run_id, g.seg_pos, CASE WHEN isfinite(g.s) THEN g.s END AS s, r.duration
  FROM q_raw_segments g JOIN q_runs r USING (run_id))""")
def running_floor(v: Views) -> DataFrame:
    finite = F.when(~F.isnan("start"), F.col("start"))
    rows = running_before(v.raw_segments, ["run_id"], "seg_pos", {"m": ("max", finite)})
    floor = F.least(F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))), F.col("duration"))
    return rows.join(v.runs, "run_id").select("run_id", "seg_pos", ms(floor).alias("floor_ms"))


@plan("transcript_invariants", """
SELECT run_id, seg_pos, -1::BIGINT AS word_pos, unnest(list_filter([
    CASE WHEN seg_pos <> coalesce(previous + 1, 0) THEN 'index_not_contiguous' END,
    CASE WHEN s < 0 THEN 'negative_start' END, CASE WHEN e < s THEN 'end_before_start' END,
    CASE WHEN s < before THEN 'starts_before_previous' END,
    CASE WHEN e > duration THEN 'ends_beyond_duration' END], lambda x: x IS NOT NULL)) AS problem
FROM (SELECT g.*, r.duration, lag(g.s) OVER (PARTITION BY g.run_id ORDER BY g.seg_pos) AS before,
        lag(g.seg_pos) OVER (PARTITION BY g.run_id ORDER BY g.seg_pos) AS previous
      FROM q_raw_segments g JOIN q_runs r USING (run_id))
UNION ALL
SELECT run_id, seg_pos, word_pos, unnest(list_filter([
    CASE WHEN e < s THEN 'word_end_before_start' END,
    CASE WHEN s < gs OR e > ge THEN 'word_outside_segment' END,
    CASE WHEN s < before THEN 'word_before_previous' END], lambda x: x IS NOT NULL))
FROM (SELECT w.*, g.s AS gs, g.e AS ge,
        lag(w.s) OVER (PARTITION BY w.run_id, w.seg_pos ORDER BY w.word_pos) AS before
      FROM q_raw_words w JOIN q_raw_segments g USING (run_id, seg_pos))""")
def transcript_invariants(v: Views) -> DataFrame:
    found = N.invariant_violations(
        v.raw_segments.withColumnRenamed("seg_pos", "index"),
        v.raw_words.withColumnRenamed("seg_pos", "index"), v.runs)
    return found.withColumnRenamed("index", "seg_pos")


@plan("order_violations", """
SELECT run_id, seg_pos FROM (SELECT run_id, seg_pos, s,
  lag(s) OVER (PARTITION BY run_id ORDER BY seg_pos) AS before FROM q_raw_segments)
WHERE s < before""")
def order_violations(v: Views) -> DataFrame:
    rows = running_before(
        v.raw_segments, ["run_id"], "seg_pos", {"before": ("last", F.col("start"))})
    return rows.where("start < before").select("run_id", "seg_pos")


part("q_ordered", """
SELECT run_id, 'segment_index' AS kind, seg_pos AS position,
  CASE WHEN (run_id * 7 + seg_pos) % 53 = 0 THEN seg_pos - 2 ELSE seg_pos END AS value
FROM q_raw_segments
UNION ALL SELECT run_id, 'rank', rank, CASE WHEN (run_id * 5 + rank) % 19 = 0 THEN rank - 1 ELSE rank END
FROM q_selected""")


@plan("sequence_violations", """
SELECT run_id, kind, position FROM (SELECT *, lag(value) OVER (
  PARTITION BY run_id, kind ORDER BY position) AS before FROM q_ordered)
WHERE value <= before""")
def sequence_violations(v: Views) -> DataFrame:
    """Segment indices and ranks that do not rise from one record to the next."""
    c = F.col
    indices = v.raw_segments.select(
        "run_id", F.lit("segment_index").alias("kind"), c("seg_pos").alias("position"),
        F.when((c("run_id") * 7 + c("seg_pos")) % 53 == 0, c("seg_pos") - 2)
        .otherwise(c("seg_pos")).alias("value"))
    ranks = v.selected.select(
        "run_id", F.lit("rank").alias("kind"), c("rank").alias("position"),
        F.when((c("run_id") * 5 + c("rank")) % 19 == 0, c("rank") - 1)
        .otherwise(c("rank")).alias("value"))
    return N.not_rising(indices.unionByName(ranks), ["run_id", "kind"], "position", "value").select(
        "run_id", "kind", "position")


@plan("dense_numbering", """
SELECT run_id, seg_pos, (row_number() OVER (PARTITION BY run_id ORDER BY seg_pos) - 1)::BIGINT AS n
FROM q_raw_segments WHERE trim(text) <> ''""")
def dense_numbering(v: Views) -> DataFrame:
    kept = v.raw_segments.where(F.trim("text") != "")
    return dense_number(kept, ["run_id"], "seg_pos", "n").select("run_id", "seg_pos", "n")
