"""Audits: recorded artifacts against the tables they claim to describe.

Each audit is equi joins plus one ordered first-problem expression; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import close, first_problem, overlap_ratio, reasons
from cliploom.rules import MediaTarget

CLIP = ["run_id", "candidate_id"]


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def reconcile_index(index: DataFrame, shortlist: DataFrame, with_decision: bool) -> DataFrame:
    """Recorded files against the candidates that should have one; NULL problem when equal."""
    columns = ["start", "end", "rank"] + (["decision"] if with_decision else [])
    a = _prefixed(index.select(*CLIP, *columns, F.lit(True).alias("here")), "i_", CLIP)
    b = _prefixed(shortlist.select(*CLIP, *columns, F.lit(True).alias("here")), "s_", CLIP)
    c = F.col
    checks = [
        ("missing", c("i_here").isNull()),
        ("extra", c("s_here").isNull()),
        *([("decision_differs", c("i_decision") != c("s_decision"))] if with_decision else []),
        ("interval_differs",
         ~close(c("i_start"), c("s_start")) | ~close(c("i_end"), c("s_end"))),
        ("rank_differs", c("i_rank") != c("s_rank")),
    ]
    return a.join(b, CLIP, "full_outer").select(*CLIP, first_problem(checks).alias("problem"))


def reconcile_metadata(metadata: DataFrame, index: DataFrame) -> DataFrame:
    """First shared field a metadata document and the index entry of its directory disagree on;
    a directory with only one of the two is reported as well."""
    keys, here = ["run_id", "directory"], F.lit(True).alias("here")
    a = _prefixed(metadata.select("*", here), "m_", keys)
    b = _prefixed(index.select("*", here), "i_", keys)
    return a.join(b, keys, "full_outer").select(*keys, first_problem([
        ("missing_metadata", F.col("m_here").isNull()),
        ("missing_index", F.col("i_here").isNull()),
        *[(name, ~F.col(f"m_{name}").eqNullSafe(F.col(f"i_{name}")))
          for name in rules.SHARED_FIELDS],
    ]).alias("problem"))


def reconcile_files(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, changed or not described by any record."""
    keys = ["run_id", "directory", "name"]
    a, b = _prefixed(recorded, "r_", keys), _prefixed(actual, "a_", keys)
    return a.join(b, keys, "full_outer").select(*keys, first_problem([
        ("stray", F.col("r_sha256").isNull()),
        ("missing", F.col("a_sha256").isNull()),
        ("changed", (F.col("r_size_bytes") != F.col("a_size_bytes"))
         | (F.col("r_sha256") != F.col("a_sha256"))),
    ]).alias("problem"))


def check_media(media: DataFrame, targets: DataFrame, wanted: MediaTarget) -> DataFrame:
    """First way a produced file is not what was asked for; a target without a file and a file
    without a target are reported as well."""
    c = F.col
    ratio = [] if wanted.pixel_ratio is None else [
        ("pixel_ratio_missing", c("sample_aspect_ratio").isNull()),
        ("pixel_ratio", c("sample_aspect_ratio") != wanted.pixel_ratio),
    ]
    length = c("end") - c("start")
    found = media.withColumn("_found", F.lit(True))
    asked = targets.select(*CLIP, "start", "end", F.lit(True).alias("_asked"))
    return found.join(asked, CLIP, "full_outer").select(*CLIP, first_problem([
        ("missing_media", c("_found").isNull()),
        ("unknown_target", c("_asked").isNull()),
        ("dimensions", (c("width") != wanted.width) | (c("height") != wanted.height)),
        ("video_codec", ~c("video_codec").eqNullSafe(F.lit(wanted.video_codec))),
        *ratio,
        ("no_audio", c("audio_codec").isNull()),
        ("audio_codec", c("audio_codec") != wanted.audio_codec),
        ("duration_drift", F.abs(c("duration_seconds") - length) > wanted.tolerance),
    ]).alias("problem"))


def audit_dedup_events(events: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Every event against the two records it names, and dropped records without an event.

    The recorded ratio must reach the threshold exactly, while the decision itself allows
    1e-9 below it: a ratio in that sliver is dropped and then reported here.
    """
    c = F.col
    scored = candidates.where("status <> 'invalid'").select(
        "run_id", "candidate_id", "status", "rejection_reasons", "start", "end", "total_score")
    kept = _prefixed(scored, "k_", CLIP).withColumnRenamed("candidate_id", "kept_id")
    dropped = _prefixed(scored, "d_", CLIP).withColumnRenamed("candidate_id", "dropped_id")
    times = events.groupBy("run_id", "dropped_id").agg(F.count("*").alias("_times"))
    tie = close(c("kept_score"), c("dropped_score"), rules.SCORE_EPSILON)
    real = overlap_ratio(c("k_start"), c("k_end"), c("d_start"), c("d_end"))
    checked = (
        events.join(times, ["run_id", "dropped_id"])
        .join(kept, ["run_id", "kept_id"], "left").join(dropped, ["run_id", "dropped_id"], "left")
        .select("run_id", "kept_id", "dropped_id", first_problem([
            ("same_candidate", c("kept_id") == c("dropped_id")),
            ("unknown_candidate", c("k_status").isNull() | c("d_status").isNull()),
            ("dropped_not_deduplicated", c("d_status") != "deduplicated"),
            ("removed_twice", c("_times") > 1),
            ("keeper_did_not_survive", (c("k_status") == "deduplicated")
             | (c("k_rejection_reasons") == F.array(F.lit("below_min_score")))),
            ("kept_score_differs",
             ~close(c("kept_score"), c("k_total_score"), rules.SCORE_EPSILON)),
            ("dropped_score_differs",
             ~close(c("dropped_score"), c("d_total_score"), rules.SCORE_EPSILON)),
            ("keeper_scored_lower",
             c("kept_score") < c("dropped_score") - rules.SCORE_EPSILON),
            ("tie_broken_wrong", tie & (F.struct("k_start", "kept_id")
                                        > F.struct("d_start", "dropped_id"))),
            ("iou_differs", ~close(c("iou"), real, rules.IOU_AUDIT_EPSILON)),
            ("below_threshold", c("iou") < threshold),
        ]).alias("problem"))
    )
    silent = scored.where("status = 'deduplicated'").select(
        "run_id", F.lit(None).cast("string").alias("kept_id"), c("candidate_id").alias("dropped_id")
    ).join(events.select("run_id", "dropped_id"), ["run_id", "dropped_id"], "left_anti")
    return checked.unionByName(silent.withColumn("problem", F.lit("no_event")))


def boundary_problems() -> Column:
    """What a boundary record claims against what its numbers say."""
    c = F.col
    still = close(c("adjusted_start"), c("proposed_start")) & close(
        c("adjusted_end"), c("proposed_end"))
    quiet = close(c("start_delta"), F.lit(0.0)) & close(c("end_delta"), F.lit(0.0))
    calm = (c("start_anchor_kind") == "unchanged") & (c("end_anchor_kind") == "unchanged")
    return reasons([
        ("proposed_not_ordered", c("proposed_end") <= c("proposed_start")),
        ("adjusted_not_ordered", c("adjusted_end") <= c("adjusted_start")),
        ("reverted_but_moved", c("reverted") & ~still),
        ("reverted_with_delta", c("reverted") & ~quiet),
        ("reverted_with_anchor", c("reverted") & ~calm),
        ("start_delta_differs", ~c("reverted") & ~close(
            c("start_delta"), c("adjusted_start") - c("proposed_start"))),
        ("end_delta_differs", ~c("reverted") & ~close(
            c("end_delta"), c("adjusted_end") - c("proposed_end"))),
    ])


def record_problems() -> Column:
    """Status, reasons, rank and interval of a scored record against each other."""
    c = F.col
    suggested = c("status") == "suggested"
    n = F.size("rejection_reasons")
    allowed: Column = F.lit(False)
    for status, names in rules.TERMINAL_REASONS.items():
        allowed = allowed | ((c("status") == status)
                             & F.get("rejection_reasons", F.lit(0)).isin(*names))
    return reasons([
        ("not_ordered", c("end") <= c("start")),
        ("duration_differs", ~close(c("length"), c("end") - c("start"))),
        ("start_not_adjusted", ~close(c("start"), c("adjusted_start"))),
        ("end_not_adjusted", ~close(c("end"), c("adjusted_end"))),
        ("suggested_with_reason", suggested & (n > 0)),
        ("no_reason", ~suggested & (n == 0)),
        ("ranked_but_not_selected", ~suggested & c("rank").isNotNull()),
        ("several_reasons", ~suggested & (n > 1)),
        ("wrong_reason", ~suggested & (n == 1) & ~allowed),
    ])


def identity_problems(transcripts: DataFrame, chunks: DataFrame, raw: DataFrame,
                      candidates: DataFrame, config: DataFrame, answers: DataFrame) -> DataFrame:
    """First way the records of an analysis contradict each other, per run of any record; a
    record that a run lacks comes first.

    ``answers`` holds runs whose answered chunks are not exactly the chunks cut.
    """
    key, c = ["run_id"], F.col
    joined = transcripts.withColumn("here", F.lit(True))
    for prefix, df in (("c_", chunks), ("r_", raw), ("s_", candidates), ("f_", config)):
        held = _prefixed(df.withColumn("here", F.lit(True)), prefix, key)
        joined = joined.join(held, "run_id", "full_outer")
    uncovered = answers.select("run_id").distinct().withColumn("_uncovered", F.lit(True))

    def differ(a: str, b: str) -> Column:
        return ~c(a).eqNullSafe(c(b))

    version = "c_rules_version"
    return joined.join(uncovered, "run_id", "left").select("run_id", first_problem([
        *[(f"missing_{name}", c(f"{prefix}here").isNull()) for prefix, name in (
            ("", "transcript"), ("c_", "chunks"), ("r_", "raw"), ("s_", "candidates"),
            ("f_", "config"))],
        ("chunks_transcript", differ("c_transcript_sha256", "transcript_sha256")),
        ("raw_transcript", differ("r_transcript_sha256", "c_transcript_sha256")),
        *[(name, differ(f"r_{name}", f"f_{name}")) for name in rules.EXECUTOR_FIELDS],
        ("answered_chunks", c("_uncovered").isNotNull()),
        ("proposed_count", differ("r_proposed_count", "s_proposed")),
        ("source_duration", differ("s_source_duration", "c_source_duration")),
        ("rules_version", differ(version, "r_rules_version") | differ(version, "s_rules_version")
         | differ(version, "f_rules_version")),
        *[(name, differ(f"s_{name}", f"f_{name}")) for name in rules.POLICY_FIELDS],
    ]).alias("problem"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def rank_contiguity(ranked: DataFrame) -> DataFrame:
    """Per run: are the ranks exactly 1..n, and are they at least all different?

    Counted, not sorted: 1..n is a smallest of 1, a largest of n and n different values.
    """
    stats = ranked.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.countDistinct("rank").alias("different"))
    return stats.select(
        "run_id",
        ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("different") == F.col("n")))
        .alias("contiguous"),
        (F.col("different") == F.col("n")).alias("strictly_increasing"),
    )
