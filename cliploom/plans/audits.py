"""Queries that audit recorded artifacts; faults are placed by a hash of the identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import safe_identifier
from cliploom.operators import audit as A
from cliploom.plans.registry import part, plan
from cliploom.plans.views import VIEW_POLICY, Views

_X_SQL = "('0x' || substr(candidate_id, 6, 4))::BIGINT"


def mark() -> Column:
    """A number between 0 and 65535 from the identifier."""
    return F.expr("conv(substr(candidate_id, 6, 4), 16, 10)").cast("bigint")


part("q_index_full", f"""
SELECT run_id, candidate_id, rank, decision, os, oe, s, e, e - s AS duration, 1080 AS width,
  1920 AS height, '1:1' AS sample_aspect_ratio, 'h264' AS video_codec, 'aac' AS audio_codec,
  e - s + 0.02 AS measured, sha256(candidate_id || ':clip') AS sha, 1000 + {_X_SQL} AS size_bytes,
  sha256(candidate_id || ':srt') AS srt_sha, sha256(candidate_id || ':ass') AS ass_sha,
  {_X_SQL} % 9 AS cue_count, true AS burned, {_X_SQL} AS x FROM q_targets""")


def clip_index(v: Views) -> DataFrame:
    """The index entries a correct render would have recorded."""
    x = mark()
    c = F.col
    return v.targets.select(
        "run_id", "candidate_id", "rank", "decision", "original_start", "original_end", "start",
        "end", (c("end") - c("start")).alias("duration"), F.lit(1080).alias("width"),
        F.lit(1920).alias("height"), F.lit("1:1").alias("sample_aspect_ratio"),
        F.lit("h264").alias("video_codec"), F.lit("aac").alias("audio_codec"),
        (c("end") - c("start") + 0.02).alias("measured_duration_seconds"),
        F.sha2(F.concat("candidate_id", F.lit(":clip")), 256).alias("sha256"),
        (x + 1000).alias("size_bytes"),
        F.sha2(F.concat("candidate_id", F.lit(":srt")), 256).alias("srt_sha256"),
        F.sha2(F.concat("candidate_id", F.lit(":ass")), 256).alias("ass_sha256"),
        (x % 9).alias("cue_count"), F.lit(True).alias("subtitles_burned"), x.alias("x"),
    )


@plan("index_reconcile", """
SELECT run_id, candidate_id, CASE x % 17 WHEN 1 THEN 'missing' WHEN 4 THEN 'decision_differs'
  WHEN 2 THEN 'interval_differs' WHEN 3 THEN 'rank_differs' ELSE 'ok' END AS verdict
FROM q_index_full
UNION ALL SELECT run_id, candidate_id || '_x', 'extra' FROM q_index_full WHERE x % 17 = 5""")
def index_reconcile(v: Views) -> DataFrame:
    return A.reconcile_index(_faulty_index(v), v.targets, True).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


def _faulty_index(v: Views) -> DataFrame:
    c, f = F.col, F.col("x") % 17
    index = clip_index(v)
    extra = index.where(f == 5).withColumn("candidate_id", F.concat("candidate_id", F.lit("_x")))
    other = F.when(c("decision") == "approved", F.lit("edited")).otherwise(F.lit("approved"))
    damaged = index.where(f != 1).withColumns({
        "start": F.when(f == 2, c("start") + 0.5).otherwise(c("start")),
        "rank": F.when(f == 3, c("rank") + 1).otherwise(c("rank")),
        "decision": F.when(f == 4, other).otherwise(c("decision")),
    })
    return damaged.unionByName(extra)


@plan("preview_reconcile", """
SELECT run_id, candidate_id, CASE x % 17 WHEN 1 THEN 'missing' WHEN 2 THEN 'interval_differs'
  WHEN 3 THEN 'rank_differs' ELSE 'ok' END AS verdict
FROM (SELECT run_id, candidate_id, """ + _X_SQL + """ AS x FROM q_selected)
UNION ALL SELECT run_id, candidate_id || '_x', 'extra'
FROM (SELECT run_id, candidate_id, """ + _X_SQL + """ AS x FROM q_selected) WHERE x % 17 = 5""")
def preview_reconcile(v: Views) -> DataFrame:
    """The same audit for previews: every selected candidate, no decision involved."""
    c, f = F.col, F.col("x") % 17
    index = v.selected.select("run_id", "candidate_id", "rank", "start", "end", mark().alias("x"))
    extra = index.where(f == 5).withColumn("candidate_id", F.concat("candidate_id", F.lit("_x")))
    damaged = index.where(f != 1).withColumns({
        "start": F.when(f == 2, c("start") + 0.5).otherwise(c("start")),
        "rank": F.when(f == 3, c("rank") + 1).otherwise(c("rank")),
    })
    return A.reconcile_index(damaged.unionByName(extra), v.selected, False).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


@plan("metadata_reconcile", """
SELECT run_id, 'clip_' || candidate_id AS directory, CASE x % 23 WHEN 0 THEN 'rank' WHEN 1 THEN 'end'
  WHEN 2 THEN 'video_codec' WHEN 3 THEN 'size_bytes' WHEN 4 THEN 'cue_count'
  WHEN 5 THEN 'sample_aspect_ratio' WHEN 6 THEN 'subtitles_burned' WHEN 7 THEN 'srt_sha256'
  WHEN 8 THEN 'candidate_id' WHEN 9 THEN 'missing_metadata' WHEN 10 THEN 'missing_index'
  ELSE 'ok' END AS verdict FROM q_index_full""")
def metadata_reconcile(v: Views) -> DataFrame:
    c, f = F.col, F.col("x") % 23
    index = clip_index(v).withColumn("directory", F.concat(F.lit("clip_"), c("candidate_id")))
    meta = index.where(f != 9).withColumns({
        "candidate_id": F.when(f == 8, F.lit("cand_other")).otherwise(c("candidate_id")),
        "rank": F.when(f == 0, c("rank") + 1).otherwise(c("rank")),
        "end": F.when(f == 1, c("end") + 0.5).otherwise(c("end")),
        "video_codec": F.when(f == 2, F.lit("hevc")).otherwise(c("video_codec")),
        "size_bytes": F.when(f == 3, c("size_bytes") + 1).otherwise(c("size_bytes")),
        "cue_count": F.when(f == 4, c("cue_count") + 1).otherwise(c("cue_count")),
        "sample_aspect_ratio": F.when(f != 5, c("sample_aspect_ratio")),
        "subtitles_burned": f != 6,
        "srt_sha256": F.when(f == 7, F.lit("bad")).otherwise(c("srt_sha256")),
    })
    return A.reconcile_metadata(meta, index.where(f != 10)).select(
        "run_id", "directory", F.coalesce("problem", F.lit("ok")).alias("verdict"))


_NAMES = ("clip.mp4", "subtitles.srt", "subtitles.ass", "metadata.json")


def recorded_files(v: Views) -> DataFrame:
    x = mark()
    entries = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.sha2(F.concat("candidate_id", F.lit(f":{name}")), 256).alias("sha256"),
                 (x + 100 * i).alias("size_bytes"), ((x + i * 7) % 19).alias("f"))
        for i, name in enumerate(_NAMES)
    ])
    return v.targets.select(
        "run_id", F.concat(F.lit("clip_"), "candidate_id").alias("directory"),
        F.explode(entries).alias("file"), x.alias("x"),
    ).select("run_id", "directory", "file.*", "x")


@plan("file_reconcile", f"""
SELECT run_id, 'clip_' || candidate_id AS directory, name,
  CASE (x + i * 7) % 19 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed'
  ELSE 'ok' END AS verdict
FROM (SELECT *, unnest({list(_NAMES)}) AS name, unnest([0, 1, 2, 3]) AS i FROM q_index_full)
UNION ALL
SELECT run_id, 'clip_' || candidate_id, 'notes.txt', 'stray' FROM q_index_full WHERE x % 29 = 0""")
def file_reconcile(v: Views) -> DataFrame:
    c = F.col
    recorded = recorded_files(v)
    actual = recorded.where("f <> 0").select(
        "run_id", "directory", "name",
        F.when(c("f") == 2, F.lit("other")).otherwise(c("sha256")).alias("sha256"),
        F.when(c("f") == 1, c("size_bytes") + 1).otherwise(c("size_bytes")).alias("size_bytes"))
    stray = recorded.where("name = 'clip.mp4' AND x % 29 = 0").select(
        "run_id", "directory", F.lit("notes.txt").alias("name"), "sha256", "size_bytes")
    return A.reconcile_files(
        recorded.select("run_id", "directory", "name", "sha256", "size_bytes"),
        actual.unionByName(stray),
    ).select("run_id", "directory", "name", F.coalesce("problem", F.lit("ok")).alias("verdict"))


@plan("output_media_check", """
SELECT run_id, candidate_id, CASE x % 13 WHEN 0 THEN 'dimensions' WHEN 1 THEN 'video_codec'
  WHEN 2 THEN 'pixel_ratio_missing' WHEN 3 THEN 'pixel_ratio' WHEN 4 THEN 'no_audio'
  WHEN 5 THEN 'audio_codec' WHEN 6 THEN 'duration_drift' WHEN 8 THEN 'missing_media'
  ELSE 'ok' END AS verdict
FROM q_index_full
UNION ALL SELECT run_id, candidate_id || '_x', 'unknown_target' FROM q_index_full WHERE x % 13 = 9""")
def output_media_check(v: Views) -> DataFrame:
    f = F.col("x") % 13
    length = F.col("end") - F.col("start")
    media = clip_index(v).select(
        "run_id", "candidate_id", F.when(f == 0, 720).otherwise(1080).alias("width"),
        F.lit(1920).alias("height"),
        F.when(f == 1, F.lit("hevc")).otherwise(F.lit("h264")).alias("video_codec"),
        F.when(f == 3, F.lit("4:3")).when(f != 2, F.lit("1:1")).alias("sample_aspect_ratio"),
        F.when(f == 5, F.lit("mp3")).when(f != 4, F.lit("aac")).alias("audio_codec"),
        F.when(f == 6, length + 1.2).when(f == 7, length + 0.9).otherwise(length)
        .alias("duration_seconds"), f.alias("f"))
    extra = media.where("f = 9").withColumn(
        "candidate_id", F.concat("candidate_id", F.lit("_x")))
    media = media.where("f <> 8").unionByName(extra).drop("f")
    return A.check_media(media, v.targets, rules.CLIP_TARGET).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


part("q_events_full", """
SELECT run_id, kept_id, id AS dropped_id, iou, kept_total, total,
  ('0x' || substr(id, 6, 4))::BIGINT % 11 AS f FROM q_dedup_steps WHERE kept_id IS NOT NULL""")
part("q_events_faulty", """
SELECT run_id, CASE WHEN f = 1 THEN 'cand_none' WHEN f = 2 THEN dropped_id ELSE kept_id END AS kept_id,
  dropped_id, CASE WHEN f = 5 THEN iou + 0.01 ELSE iou END AS iou,
  CASE WHEN f = 3 THEN kept_total + 1 ELSE kept_total END AS kept_score,
  CASE WHEN f = 4 THEN total - 1 ELSE total END AS dropped_score, f
FROM q_events_full WHERE f <> 0
UNION ALL SELECT run_id, kept_id, dropped_id, iou, kept_total, total, f FROM q_events_full WHERE f = 6""")


@plan("dedup_event_audit", """
SELECT DISTINCT run_id, kept_id, dropped_id, CASE f WHEN 1 THEN 'unknown_candidate'
  WHEN 2 THEN 'same_candidate' WHEN 3 THEN 'kept_score_differs' WHEN 4 THEN 'dropped_score_differs'
  WHEN 5 THEN 'iou_differs' WHEN 6 THEN 'removed_twice' WHEN 7 THEN 'below_threshold'
  ELSE 'ok' END AS verdict
FROM (SELECT * REPLACE (CASE WHEN f NOT IN (1, 2, 3, 4, 5, 6) AND iou < 0.6 THEN 7
        WHEN f = 7 THEN 8 ELSE f END AS f) FROM q_events_faulty)
UNION ALL SELECT run_id, NULL, dropped_id, 'no_event' FROM q_events_full WHERE f = 0""")
def dedup_event_audit(v: Views) -> DataFrame:
    from cliploom.operators.selection import dedup_events

    c = F.col
    full = dedup_events(v.outcomes).withColumn(
        "f", F.expr("conv(substr(dropped_id, 6, 4), 16, 10)").cast("bigint") % 11)
    f = c("f")
    faulty = full.where("f <> 0").withColumns({
        "kept_id": F.when(f == 1, F.lit("cand_none")).when(f == 2, c("dropped_id"))
        .otherwise(c("kept_id")),
        "iou": F.when(f == 5, c("iou") + 0.01).otherwise(c("iou")),
        "kept_score": F.when(f == 3, c("kept_score") + 1).otherwise(c("kept_score")),
        "dropped_score": F.when(f == 4, c("dropped_score") - 1).otherwise(c("dropped_score")),
    }).unionByName(full.where("f = 6")).drop("f")
    return A.audit_dedup_events(faulty, v.outcomes, VIEW_POLICY.dedupe_iou).select(
        "run_id", "kept_id", "dropped_id", F.coalesce("problem", F.lit("ok")).alias("verdict"),
    ).distinct()


@plan("boundary_record_check", f"""
SELECT run_id, candidate_id, CASE f WHEN 0 THEN 'start_delta_differs'
  WHEN 1 THEN array_to_string(list_filter([
    CASE WHEN abs(fs - s) > 1e-6 OR abs(fe - e) > 1e-6 THEN 'reverted_but_moved' END,
    CASE WHEN abs(fs - s) > 1e-6 OR abs(fe - e) > 1e-6 THEN 'reverted_with_delta' END,
    CASE WHEN start_kind <> 'unchanged' OR end_kind <> 'unchanged' THEN 'reverted_with_anchor' END
    ], lambda x: x IS NOT NULL), ',')
  WHEN 2 THEN 'adjusted_not_ordered,end_delta_differs' ELSE '' END AS problems
FROM (SELECT *, CASE WHEN reverted THEN 3 ELSE {_X_SQL} % 19 END AS f FROM q_snapped
  WHERE reasons = '')""")
def boundary_record_check(v: Views) -> DataFrame:
    c = F.col
    f = F.when(c("was_reverted"), 3).otherwise(c("x") % 19)
    rows = v.assessed.where(F.size("invalid_reasons") == 0).withColumn("x", mark()).withColumn(
        "was_reverted", c("reverted")).withColumnsRenamed({"start": "proposed_start", "end": "proposed_end"})
    faulty = rows.withColumns({
        "start_delta": F.when(f == 0, c("start_delta") + 0.25).otherwise(c("start_delta")),
        "reverted": (f == 1) | c("was_reverted"),
        "adjusted_end": F.when(f == 2, c("adjusted_start")).otherwise(c("adjusted_end")),
    })
    return faulty.select(
        "run_id", "candidate_id", F.array_join(A.boundary_problems(), ",").alias("problems"))


@plan("candidate_record_check", f"""
SELECT run_id, candidate_id, CASE x % 19
  WHEN 0 THEN 'duration_differs' WHEN 1 THEN 'duration_differs,start_not_adjusted'
  WHEN 2 THEN CASE WHEN outcome = 'selected' THEN 'suggested_with_reason' ELSE 'several_reasons' END
  WHEN 3 THEN CASE WHEN outcome = 'selected' THEN '' ELSE 'no_reason' END
  WHEN 4 THEN CASE WHEN outcome = 'selected' THEN '' ELSE 'ranked_but_not_selected' END
  WHEN 5 THEN CASE WHEN outcome = 'selected' THEN 'suggested_with_reason' ELSE 'wrong_reason' END
  ELSE '' END AS problems
FROM (SELECT *, {_X_SQL} AS x FROM q_outcomes WHERE outcome <> 'invalid')""")
def candidate_record_check(v: Views) -> DataFrame:
    c, f = F.col, F.col("x") % 19
    more = F.concat("rejection_reasons", F.array(F.lit("duplicate")))
    rows = v.outcomes.where("outcome <> 'invalid'").withColumn("x", mark()).withColumns({
        "adjusted_start": c("start"), "adjusted_end": c("end"), "length": c("end") - c("start")})
    faulty = rows.withColumns({
        "length": F.when(f == 0, c("length") + 0.5).otherwise(c("length")),
        "start": F.when(f == 1, c("start") + 0.5).otherwise(c("start")),
        "rejection_reasons": F.when(f == 2, more)
        .when(f == 3, F.array().cast("array<string>"))
        .when(f == 5, F.array(F.lit("ungrounded"))).otherwise(c("rejection_reasons")),
        "rank": F.when(f == 4, F.lit(9).cast("bigint")).otherwise(c("rank")),
    })
    return faulty.select(
        "run_id", "candidate_id", F.array_join(A.record_problems(), ",").alias("problems"))


@plan("safe_identifier", """
SELECT event_id, name, regexp_full_match(name, '[A-Za-z0-9_-]+') AS safe,
  CASE WHEN regexp_full_match(name, '[A-Za-z0-9_-]+') THEN 'candidate_' || name || '.mp4' END
    AS preview_file,
  CASE WHEN regexp_full_match(name, '[A-Za-z0-9_-]+') THEN 'clip_' || name END AS clip_directory
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '../' || event_type WHEN 1 THEN ''
  WHEN 2 THEN event_type || ' ' || user_id WHEN 3 THEN event_type || chr(10)
  WHEN 4 THEN 'é' || user_id ELSE event_type || '_' || user_id || '-x' END AS name FROM events)""")
def safe_identifiers(v: Views) -> DataFrame:
    c, f = F.col, F.col("event_id") % 7
    name = (
        F.when(f == 0, F.concat(F.lit("../"), "event_type")).when(f == 1, F.lit(""))
        .when(f == 2, F.concat_ws(" ", "event_type", "user_id"))
        .when(f == 3, F.concat("event_type", F.lit("\n")))
        .when(f == 4, F.concat(F.lit("é"), c("user_id").cast("string")))
        .otherwise(F.concat("event_type", F.lit("_"), c("user_id").cast("string"), F.lit("-x")))
    )
    rows = v.table("events").select("event_id", name.alias("name")).withColumn(
        "safe", safe_identifier(F.col("name")))
    return rows.withColumns({
        "preview_file": F.when(
            c("safe"), F.concat(F.lit("candidate_"), "name", F.lit(".mp4"))),
        "clip_directory": F.when(c("safe"), F.concat(F.lit("clip_"), "name")),
    })


@plan("contiguity_check", f"""
SELECT run_id, list_sort(list(r)) = range(1, count(*) + 1) AS contiguous,
  count(DISTINCT r) = count(*) AS strictly_increasing
FROM (SELECT run_id, CASE WHEN {_X_SQL} % 11 = 0 THEN rank + 1 ELSE rank END AS r FROM q_selected)
GROUP BY run_id""")
def contiguity_check(v: Views) -> DataFrame:
    ranked = v.selected.select(
        "run_id", F.when(mark() % 11 == 0, F.col("rank") + 1).otherwise(F.col("rank"))
        .alias("rank"))
    return A.rank_contiguity(ranked)


@plan("duplicate_keys", """
SELECT user_id AS run_id, props AS candidate, event_type AS decision, count(*) AS copies
FROM events GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(v: Views) -> DataFrame:
    rows = v.table("events").select(
        F.col("user_id").alias("run_id"), F.col("props").alias("candidate"),
        F.col("event_type").alias("decision"))
    return A.duplicate_keys(rows, ["run_id", "candidate", "decision"])


@plan("set_differences", """
SELECT run_id, 'clip_' || candidate_id AS directory, 'unexpected' AS side FROM q_selected
WHERE (run_id, candidate_id) NOT IN (SELECT run_id, candidate_id FROM q_targets)
UNION ALL SELECT run_id, 'clip_' || candidate_id, 'absent' FROM q_targets
WHERE """ + _X_SQL + """ % 17 = 1""")
def set_differences(v: Views) -> DataFrame:
    """Directories of an earlier, longer shortlist against the current one."""
    name = F.concat(F.lit("clip_"), "candidate_id").alias("directory")
    now = v.targets.select("run_id", name)
    found = v.selected.where(
        mark() % 17 != 1).select("run_id", name).unionByName(
        v.selected.join(v.targets, ["run_id", "candidate_id"], "left_anti").where(
            mark() % 17 == 1).select("run_id", name))
    keys = ["run_id", "directory"]
    return found.join(now, keys, "left_anti").withColumn("side", F.lit("unexpected")).unionByName(
        now.join(found, keys, "left_anti").withColumn("side", F.lit("absent")))


part("q_identity", """
SELECT run_id, run_id % 41 AS f FROM q_runs""")


@plan("identity_coherence", """
SELECT i.run_id, CASE f WHEN 0 THEN 'chunks_transcript' WHEN 1 THEN 'raw_transcript'
  WHEN 2 THEN 'model' WHEN 3 THEN 'prompt_sha256' WHEN 4 THEN 'fixture_sha256'
  WHEN 5 THEN 'answered_chunks' WHEN 6 THEN 'proposed_count' WHEN 7 THEN 'source_duration'
  WHEN 8 THEN 'rules_version' WHEN 9 THEN 'min_score' WHEN 10 THEN 'dedupe_iou'
  WHEN 11 THEN 'missing_chunks' WHEN 12 THEN 'missing_raw' WHEN 13 THEN 'missing_candidates'
  WHEN 14 THEN 'missing_config' WHEN 15 THEN 'missing_transcript' ELSE 'ok' END
  AS verdict FROM q_identity i WHERE run_id IN (SELECT run_id FROM q_proposals)""")
def identity_coherence(v: Views) -> DataFrame:
    c, f = F.col, F.col("run_id") % 41
    base = v.transcript_digests.join(v.runs, "run_id")
    counts = v.proposals.groupBy("run_id").agg(F.count("*").alias("n"))
    rows = base.join(counts, "run_id")

    def executor(table: str) -> list[Column]:
        wrong = table == "raw"
        return [
            F.lit("analyzer").alias("analyzer"), F.lit("1").alias("analyzer_version"),
            F.when((f == 2) & F.lit(wrong), F.lit("other")).otherwise(F.lit("m")).alias("model"),
            F.lit("p/v1").alias("prompt_version"),
            F.when((f == 3) & F.lit(wrong), F.lit("x")).otherwise(F.lit("y"))
            .alias("prompt_sha256"),
            F.when((f == 4) & F.lit(wrong), F.lit("z")).alias("fixture_sha256"),
        ]

    def policy(table: str) -> list[Column]:
        wrong = table == "candidates"
        return [
            F.lit(1).alias("score_formula_version"), F.lit(5).alias("target_candidates"),
            F.lit(5).alias("max_candidates"),
            F.when((f == 9) & F.lit(wrong), 70.0).otherwise(65.0).alias("min_score"),
            F.when((f == 10) & F.lit(wrong), 0.5).otherwise(0.6).alias("dedupe_iou"),
            F.lit(2.5).alias("boundary_snap_seconds"),
        ]

    sha = c("transcript_sha256")
    chunks = rows.select(
        "run_id", F.when(f == 0, F.lit("bad")).otherwise(sha).alias("transcript_sha256"),
        c("duration").alias("source_duration"), F.lit(1).alias("rules_version"))
    raw = rows.select(
        "run_id", F.when(f == 1, F.lit("bad")).otherwise(
            F.when(f == 0, F.lit("bad")).otherwise(sha)).alias("transcript_sha256"),
        F.lit(1).alias("rules_version"), *executor("raw"), c("n").alias("proposed_count"))
    candidates = rows.select(
        "run_id", F.when(f == 6, c("n") + 1).otherwise(c("n")).alias("proposed"),
        F.when(f == 7, c("duration") + 1).otherwise(c("duration")).alias("source_duration"),
        F.lit(1).alias("rules_version"), *policy("candidates"))
    config = rows.select(
        "run_id", F.when(f == 8, 2).otherwise(1).alias("rules_version"), *executor("config"),
        *policy("config"))
    uncovered = rows.where(f == 5).select("run_id")
    transcripts = v.transcript_digests.join(counts.select("run_id"), "run_id", "left_semi")
    return A.identity_problems(
        transcripts.where(f != 15), chunks.where(f != 11), raw.where(f != 12),
        candidates.where(f != 13), config.where(f != 14), uncovered,
    ).select("run_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))
