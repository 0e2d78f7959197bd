"""Validation, snapping and scoring of proposals.

Segments are laid out by (run, time bucket), without their words. A proposal's start and end meet
the few segments near them there, and go on to the words of these segments; every word compares
itself with the ends of its own time bucket only. What is shuffled are ends and segments, and one
nearest edge per end and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import reasons
from cliploom.operators.ledger import ranked
from cliploom.rules import Policy
from cliploom.session import write_stage


def place(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Proposals with the extent of the chunk they answer and the source duration; those that
    name an unknown chunk stay, without either."""
    where = chunks.select(
        "run_id", "chunk_id", "window_start", "window_end", "duration",
        F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"),
    )
    return proposals.join(where, ["run_id", "chunk_id"], "left")


ANSWER_PROBLEMS = ("unknown_chunk", "answered_twice", "other_model")


def answer_problems(answers: DataFrame, chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(run_id, problem, rank): answers (run_id, chunk_id, model) that do not belong to a run whose
    chunks and model (run_id, model) are known. An answer that names no model is not held to one."""
    known = chunks.select("run_id", "chunk_id", F.lit(True).alias("_known"))
    asked = models.select("run_id", F.col("model").alias("_asked"))
    copies = answers.groupBy("run_id", "chunk_id").agg(F.count("*").alias("_copies"))
    return ranked(
        answers.join(known, ["run_id", "chunk_id"], "left").join(asked, "run_id", "left")
        .join(copies, ["run_id", "chunk_id"]).select("run_id", F.explode(reasons([
            ("unknown_chunk", F.col("_known").isNull()),
            ("answered_twice", F.col("_copies") > 1),
            ("other_model", F.col("model") != F.col("_asked")),
        ])).alias("problem")), ANSWER_PROBLEMS)


def bucket_seconds(snap: float) -> float:
    return max(10.0, 4.0 * snap)


#: Buckets that segments are laid out by together: most segments lie in one such stretch or two.
STRETCH = 6


#: What a look-up is asked for: two ends, the window whose speech counts, and how far to look.
ASKED = ["run_id", "start", "end", "window_start", "window_end", "_reach"]


def _met(asked: DataFrame, segments: DataFrame, words: DataFrame, snap: float,
         words_inside: bool) -> DataFrame:
    """(_id, opens, t, _reach, segment): both ends of what is asked, one row for every
    segment of the window that has speech near the end. Only segments are laid out by time, as far
    as they and their words reach."""
    width, slack = STRETCH * bucket_seconds(snap), snap + 2 * rules.TIME_EPSILON
    laid = segments.select(
        "run_id", F.col("index").alias("seg_index"), F.col("start").alias("seg_start"),
        F.col("end").alias("seg_end"))
    first, last = F.col("seg_start"), F.col("seg_end")
    if not words_inside:
        laid = laid.join(words.groupBy("run_id", "seg_index").agg(
            F.min(F.least("start", "end")).alias("_first"),
            F.max(F.greatest("start", "end")).alias("_last")), ["run_id", "seg_index"], "left")
        first, last = F.least("seg_start", "_first"), F.greatest("seg_end", "_last")
    low, high = first - slack, last + slack
    laid = laid.withColumn("stretch", F.explode(F.sequence(
        F.floor(low / width), F.floor(high / width))))
    sides = F.array(*[F.struct(F.lit(name == "start").alias("opens"), F.col(name).alias("t"))
                      for name in ("start", "end")])
    return (
        asked.select("run_id", "_id", "window_start", "window_end", "_reach", F.inline(sides))
        .withColumn("stretch", F.floor(F.col("t") / width))
        .join(laid, ["run_id", "stretch"])
        .where((F.col("seg_end") > F.col("window_start")) & (F.col("seg_start") < F.col("window_end"))
               & F.col("t").between(low, high))
        .drop("stretch", "_first", "_last", "window_start", "window_end")
    )


def _supports(t: Column, reach: Column, start: Column, end: Column) -> Column:
    eps = rules.TIME_EPSILON
    spoken = (start - eps <= t) & (t <= end + eps)
    return spoken | (F.abs(t - start) <= reach) | (F.abs(t - end) <= reach)


def with_anchors(placed: DataFrame, segments: DataFrame, words: DataFrame, snap: float,
                 snap_column: Column | None = None, words_inside: bool = False,
                 parts: int | None = None) -> DataFrame:
    """Add ``<side>_grounded`` and ``<side>_anchor`` (nearest edge of its kind, or NULL) for both
    ends; ``snap`` is the largest reach, ``snap_column`` a row's own. ``words_inside``: no word
    reaches out of its segment, so segments alone say where speech is. ``parts``: into how many
    tasks the words are dealt by (run_id, seg_index); ends are dealt alike, once.

    The ends go to the segments they fall near, and with them to the words of these segments; the
    nearest edges are combined before they are shuffled. No word is."""
    width, slack = bucket_seconds(snap), snap + 2 * rules.TIME_EPSILON
    own = F.lit(snap) if snap_column is None else snap_column
    keyed = placed.withColumn("_reach", own.cast("double") + F.lit(rules.TIME_EPSILON))
    asked = write_stage(
        keyed.select(*ASKED).distinct().withColumn("_id", F.monotonically_increasing_id()), "asked",
        compression="zstd")
    met = write_stage(_met(asked, segments, words, snap, words_inside), "met", compression="zstd")
    end_of = F.struct("bucket", "_id", "opens", "t", "_reach")
    by_bucket = F.map_from_entries(F.transform(
        F.array_distinct(F.col("ends.bucket")),
        lambda b: F.struct(b, F.filter("ends", lambda e: e["bucket"] == b))))
    ends = met.select("run_id", "seg_index", "_id", "opens", "t", "_reach")
    if parts is not None:
        ends = ends.repartition(parts, "run_id", "seg_index")
    near = ends.withColumn("bucket", F.floor(F.col("t") / width)).groupBy("run_id", "seg_index").agg(
        F.collect_list(end_of).alias("ends")).select(
        "run_id", "seg_index", by_bucket.alias("near"))
    s_start, s_end = F.col("s_start"), F.col("s_end")
    heard = (
        words.select("run_id", "seg_index", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
        .join(near, ["run_id", "seg_index"])
        .withColumn("bucket", F.explode(F.sequence(
            F.floor((s_start - slack) / width), F.floor((s_end + slack) / width))))
        .select("s_start", "s_end", F.explode(F.filter(
            F.try_element_at("near", F.col("bucket")),
            lambda e: _supports(e["t"], e["_reach"], s_start, s_end))).alias("e"))
        .select("e._id", "e.opens", "e.t", "e._reach", F.lit(1).alias("rank"), "s_start", "s_end")
    )
    spans = met.select(
        "_id", "opens", "t", "_reach", F.lit(0).alias("rank"), F.col("seg_start").alias("s_start"),
        F.col("seg_end").alias("s_end"),
    ).where(_supports(F.col("t"), F.col("_reach"), s_start, s_end)).unionByName(heard)
    opens, at = F.col("opens"), F.when(F.col("opens"), s_start).otherwise(s_end)
    distance = F.abs(at - F.col("t"))
    anchor = F.when(distance <= F.col("_reach"), F.struct(
        distance.alias("distance"), F.col("rank").alias("rank"),
        F.when(opens, at).otherwise(-at).alias("tie")))
    found = spans.groupBy("_id").agg(
        F.min(F.when(opens, anchor)).alias("start_anchor"),
        F.min(F.when(~opens, anchor)).alias("end_anchor"),
        F.max(opens).alias("start_grounded"), F.max(~opens).alias("end_grounded"))
    told = asked.join(found, "_id").drop("_id").withColumns({
        f"{side}_anchor": F.col(f"{side}_anchor").withField("at", F.col(f"{side}_anchor.tie") * sign)
        for side, sign in (("start", 1.0), ("end", -1.0))})
    return keyed.join(told, ASKED, "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(False)) for c in ("start_grounded", "end_grounded")
    }).drop("_reach")


def validation_reasons(policy_min: Column, policy_max: Column) -> Column:
    """All reasons a proposal cannot go forward, in their fixed order."""
    eps = F.lit(rules.TIME_EPSILON)
    start, end = F.col("start"), F.col("end")
    length = end - start
    return reasons([
        ("unknown_chunk", F.col("chunk_start").isNull()),
        ("invalid_interval", (start < 0) | (end <= start + eps)),
        ("outside_chunk",
         (start < F.col("chunk_start") - eps) | (end > F.col("chunk_end") + eps)),
        ("end_beyond_source", end > F.col("duration") + eps),
        ("too_short", (length > eps) & (length < policy_min - eps)),
        ("too_long", (length > eps) & (length > policy_max + eps)),
        ("ungrounded", ~(F.col("start_grounded") & F.col("end_grounded"))),
    ])


def snap(df: DataFrame, policy_min: Column, policy_max: Column) -> DataFrame:
    """Move both ends onto their anchors, or put the whole move back if it breaks the clip."""
    eps = F.lit(rules.TIME_EPSILON)
    to_start = F.coalesce(F.col("start_anchor.at"), F.col("start"))
    to_end = F.coalesce(F.col("end_anchor.at"), F.col("end"))
    length = to_end - to_start
    broken = (
        (length <= eps) | (to_start < 0) | (to_end > F.col("duration") + eps)
        | (length < policy_min - eps) | (length > policy_max + eps)
    )

    def anchor_name(side: str) -> Column:
        rank = F.col(f"{side}_anchor.rank")
        return (
            F.when(F.col("reverted") | rank.isNull(), F.lit("unchanged"))
            .when(rank == 0, F.lit(f"segment_{side}"))
            .otherwise(F.lit(f"word_{side}"))
        )

    return (
        df.withColumn("reverted", F.coalesce(broken, F.lit(False)))
        .withColumn("adjusted_start", F.when(broken, F.col("start")).otherwise(to_start))
        .withColumn("adjusted_end", F.when(broken, F.col("end")).otherwise(to_end))
        .withColumn("start_anchor_kind", anchor_name("start"))
        .withColumn("end_anchor_kind", anchor_name("end"))
        .withColumn("start_delta", F.col("adjusted_start") - F.col("start"))
        .withColumn("end_delta", F.col("adjusted_end") - F.col("end"))
    )


def weighted_total(weights: tuple[str, ...] | list[Column] = rules.SCORE_WEIGHTS) -> Column:
    """Exact decimal total of the six ratings, rounded half up to two places."""
    total: Column | None = None
    for name, weight in zip(rules.SCORE_NAMES, weights, strict=True):
        w = weight if isinstance(weight, Column) else F.lit(weight).cast("decimal(5,4)")
        part = F.col(f"scores.{name}").cast("decimal(5,0)") * w
        total = part if total is None else total + part
    return F.round(total, 2).cast("decimal(9,2)")


def assess(placed: DataFrame, segments: DataFrame, words: DataFrame, policy: Policy,
           words_inside: bool = False, parts: int | None = None) -> DataFrame:
    """Validate, snap and score: every column the later steps need, one row per proposal."""
    low, high = F.lit(policy.min_duration), F.lit(policy.max_duration)
    # Totals are taken first, so that ratings nobody reads later are not shuffled.
    scored = placed.withColumn("total_score", weighted_total(policy.weights).cast("double"))
    seen = with_anchors(
        scored, segments, words, policy.snap_seconds, words_inside=words_inside, parts=parts)
    checked = seen.withColumn("invalid_reasons", validation_reasons(low, high))
    return snap(checked, low, high).drop(
        "start_anchor", "end_anchor", "start_grounded", "end_grounded")
