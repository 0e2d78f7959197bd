"""Normalization of raw transcripts: refuse real disagreements, correct noise, count both.

The sequential floor of the starts has a closed form: the corrected start before a row is the
largest raw start before it, held between zero and the end of the audio. That makes the loop
a running maximum, computed block by block. Refusals are per run: the first problem in
reading order wins, and a refused run yields no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import collapse_spaces, first_problem, is_finite
from cliploom.operators.scans import dense_number, running_before

_TOO_FAR = rules.CLAMP_TOLERANCE + rules.COMPARISON_EPSILON


def finite_problems(runs: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Runs holding a number that is not finite, with how many such values per grain."""
    of_runs = runs.select(
        "run_id",
        sum((~is_finite(F.col(c))).cast("bigint")
            for c in ("duration", "declared", "language_probability")).alias("run_values"),
    )
    of_segments = segments.groupBy("run_id").agg(
        F.sum(sum((~is_finite(F.col(c))).cast("bigint") for c in ("start", "end")))
        .alias("segment_values"))
    of_words = words.groupBy("run_id").agg(
        F.sum(sum((~is_finite(F.col(c))).cast("bigint")
                  for c in ("start", "end", "probability"))).alias("word_values"))
    zero = F.lit(0).cast("bigint")
    return (
        of_runs.join(of_segments, "run_id", "left").join(of_words, "run_id", "left")
        .select(
            "run_id", "run_values", F.coalesce("segment_values", zero).alias("segment_values"),
            F.coalesce("word_values", zero).alias("word_values"),
        )
        .where("run_values + segment_values + word_values > 0")
    )


def duration_gate(runs: DataFrame) -> DataFrame:
    """Runs with the first run-level problem, or NULL."""
    gap = F.abs(F.col("declared") - F.col("duration"))
    return runs.withColumn("problem", first_problem([
        ("duration_not_finite", ~is_finite(F.col("duration"))),
        ("duration_not_positive", F.col("duration") <= 0),
        ("language_probability_not_finite", ~is_finite(F.col("language_probability"))),
        ("declared_not_finite", ~is_finite(F.col("declared"))),
        ("declared_disagrees",
         gap > rules.DURATION_TOLERANCE + rules.COMPARISON_EPSILON),
    ]))


def _clamp(df: DataFrame, floor: Column, ceiling: Column) -> DataFrame:
    """Corrected start/end, which of the four corrections happened, and the first problem."""
    low, high = F.col("_floor"), F.col("_ceiling")
    raw_start, raw_end = F.col("raw_start"), F.col("raw_end")
    raised = F.col("_raised")
    df = (
        df.withColumns({"_floor": floor, "_ceiling": ceiling})
        .withColumn("_raised", F.when(raw_start < low, low).otherwise(raw_start))
        .withColumn("start", F.when(raised > high, high).otherwise(raised))
        .withColumn("_end_raised",
                    F.when(raw_end < F.col("start"), F.col("start")).otherwise(raw_end))
        .withColumn("end", F.when(F.col("_end_raised") > high, high)
                    .otherwise(F.col("_end_raised")))
    )

    def moved(up: bool, before: Column, after: Column) -> Column:
        verb = ": raised " if up else ": lowered "
        return F.concat(F.lit(verb), before.cast("string"), F.lit(" to "), after.cast("string"))

    def none_of(*tests: Column) -> Column:
        return ~F.coalesce(functools.reduce(lambda a, b: a | b, tests), F.lit(True))

    # Few rows are corrected, so the list is made for these alone.
    notes = F.when(none_of(
        raw_start < low, raised > high, raw_end < F.col("start"), F.col("_end_raised") > high,
    ), F.array().cast("array<string>")).otherwise(F.filter(F.array(
        F.when(raw_start < low, moved(True, raw_start, low)),
        F.when(raised > high, moved(False, raised, high)),
        F.when(raw_end < F.col("start"), moved(True, raw_end, F.col("start"))),
        F.when(F.col("_end_raised") > high, moved(False, F.col("_end_raised"), high)),
    ), lambda x: x.isNotNull()))
    problem = first_problem([
        ("start_not_finite", ~is_finite(raw_start)),
        ("end_not_finite", ~is_finite(raw_end)),
        ("probability_not_finite", ~is_finite(F.col("probability"))),
        ("start_before_floor", low - raw_start > _TOO_FAR),
        ("start_beyond_ceiling", raised - high > _TOO_FAR),
        ("end_before_start", F.col("start") - raw_end > _TOO_FAR),
        ("end_beyond_ceiling", F.col("_end_raised") - high > _TOO_FAR),
    ])
    return df.withColumn("notes", notes).withColumn("problem", problem).drop(
        "_raised", "_end_raised", "_floor", "_ceiling"
    )


def clamp_segments(raw_segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Every raw segment with its corrected bounds, cleaned text, notes and problem."""
    ready = (
        raw_segments.withColumnsRenamed({"start": "raw_start", "end": "raw_end"})
        .join(runs.select("run_id", "duration"), "run_id")
        .withColumn("probability", F.lit(None).cast("double"))
    )
    scanned = running_before(
        ready, ["run_id"], "seg_pos", {"_max": ("max", F.col("raw_start"))},
        summary_from=raw_segments.withColumnRenamed("start", "raw_start"))
    floor = F.least(
        F.greatest(F.lit(0.0), F.coalesce(F.col("_max"), F.lit(0.0))), F.col("duration")
    )
    clamped = _clamp(scanned, floor, F.col("duration")).drop("_max", "probability")
    clean = collapse_spaces(F.col("text"))
    return clamped.withColumn("text", clean).withColumn("dropped", clean == "")


def clamp_words(raw_words: DataFrame, clamped_segments: DataFrame) -> DataFrame:
    """Every raw word of a kept segment with its corrected bounds, notes and problem.

    The words of a segment are the text of one row, so its floor is a window over the segment. It
    needs no shuffle of words where they already lie by (run_id, seg_pos)."""
    inside = clamped_segments.where(~F.col("dropped")).select(
        "run_id", "seg_pos", F.col("start").alias("seg_start"), F.col("end").alias("seg_end")
    )
    ready = raw_words.withColumnsRenamed({"start": "raw_start", "end": "raw_end"}).join(
        inside, ["run_id", "seg_pos"]
    )
    earlier = Window.partitionBy("run_id", "seg_pos").orderBy("word_pos").rowsBetween(
        Window.unboundedPreceding, -1)
    scanned = ready.withColumn("_max", F.max("raw_start").over(earlier))
    floor = F.least(
        F.greatest(F.col("seg_start"), F.coalesce(F.col("_max"), F.col("seg_start"))),
        F.col("seg_end"),
    )
    return _clamp(scanned, floor, F.col("seg_end")).drop("_max").withColumn(
        "word", collapse_spaces(F.col("word"))
    )


def run_problems(runs: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Refused runs with the first problem in reading order. Words without one may be left out."""
    spot = F.struct("seg_pos", "part", "problem")
    at_run = duration_gate(runs).where("problem IS NOT NULL").select(
        "run_id", F.lit(-1).cast("bigint").alias("seg_pos"), F.lit(0).cast("bigint").alias("part"),
        "problem")
    at_segment = segments.where("problem IS NOT NULL").select(
        "run_id", "seg_pos", F.lit(0).cast("bigint").alias("part"), "problem")
    at_word = words.where("problem IS NOT NULL").select(
        "run_id", "seg_pos", (F.col("word_pos") + 1).alias("part"), "problem")
    return (
        at_run.unionByName(at_segment).unionByName(at_word)
        .groupBy("run_id").agg(F.min(spot).alias("first"))
        .select("run_id", "first.seg_pos", "first.part", "first.problem")
    )


def _accepted(rows: DataFrame, refused: DataFrame) -> DataFrame:
    return rows.join(refused.select("run_id"), "run_id", "left_anti")


def normalized_segments(segments: DataFrame, refused: DataFrame) -> DataFrame:
    """Surviving segments of accepted runs, numbered 0..n-1."""
    kept = _accepted(segments.where(~F.col("dropped")), refused)
    return dense_number(kept, ["run_id"], "seg_pos", "index").select(
        "run_id", "seg_pos", "index", "start", "end", "text"
    )


def normalized_words(words: DataFrame, refused: DataFrame) -> DataFrame:
    return _accepted(words, refused).select(
        "run_id", "seg_pos", "word_pos", "word", "start", "end", "probability"
    )


def report(segments: DataFrame, words: DataFrame, runs: DataFrame, refused: DataFrame
           ) -> DataFrame:
    """Counts of corrections and the first notes of every accepted run. Words without a note may be
    left out."""
    label = F.concat(F.lit("segment "), F.col("seg_pos").cast("string"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    seg_notes = F.concat("notes", F.when(
        F.col("dropped"), F.array(F.lit(": dropped, no text"))).otherwise(
        F.array().cast("array<string>")))
    of_segments = segments.select(
        "run_id", "seg_pos", zero.alias("part"), label.alias("label"), seg_notes.alias("notes"),
        F.size("notes").cast("bigint").alias("seg_clamps"), zero.alias("word_clamps"),
        F.when(F.col("dropped"), one).otherwise(zero).alias("dropped"),
    )
    of_words = words.select(
        "run_id", "seg_pos", (F.col("word_pos") + 1).alias("part"),
        F.concat(label, F.lit(" word "), F.col("word_pos").cast("string")).alias("label"),
        "notes", zero.alias("seg_clamps"), F.size("notes").cast("bigint").alias("word_clamps"),
        zero.alias("dropped"),
    )
    events = _accepted(of_segments.unionByName(of_words).where(F.size("notes") > 0), refused)
    counts = events.groupBy("run_id").agg(
        F.sum("seg_clamps").alias("clamped_segment_bounds"),
        F.sum("word_clamps").alias("clamped_word_bounds"),
        F.sum("dropped").alias("dropped_empty_segments"),
        F.sum(F.size("notes")).alias("note_count"),
    )
    order = Window.partitionBy("run_id").orderBy("seg_pos", "part")
    # Rows carry one to five notes, so the first MAX_NOTES rows hold the first MAX_NOTES notes.
    first = (
        events.select("run_id", "seg_pos", "part", "label", "notes")
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= rules.MAX_NOTES)
        .groupBy("run_id")
        .agg(F.slice(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("seg_pos", "part", "label", "notes"))),
            lambda r: F.transform(r["notes"], lambda n: F.concat(r["label"], n)),
        )), 1, rules.MAX_NOTES).alias("notes"))
    )
    more = F.when(
        F.col("note_count") > rules.MAX_NOTES, F.array(F.lit("further normalizations omitted"))
    ).otherwise(F.array().cast("array<string>"))
    base = _accepted(runs.select("run_id"), refused)
    return base.join(counts, "run_id", "left").join(first, "run_id", "left").select(
        "run_id",
        *[F.coalesce(c, zero).alias(c) for c in (
            "clamped_segment_bounds", "clamped_word_bounds", "dropped_empty_segments")],
        F.coalesce(F.concat("notes", more), F.array().cast("array<string>")).alias("notes"),
    )


def metrics(segments: DataFrame, words: DataFrame, runs: DataFrame, refused: DataFrame
            ) -> DataFrame:
    """Segment and word counts and the real-time factor of every accepted run."""
    zero = F.lit(0).cast("bigint")
    n_segments = segments.groupBy("run_id").agg(F.count("*").alias("segment_count"))
    n_words = words.groupBy("run_id").agg(F.count("*").alias("word_count"))
    factor = F.when(
        F.col("duration") > 0, F.round(F.col("processing_seconds") / F.col("duration"), 4)
    )
    return (
        _accepted(runs, refused)
        .join(n_segments, "run_id", "left").join(n_words, "run_id", "left")
        .select(
            "run_id", F.coalesce("segment_count", zero).alias("segment_count"),
            F.coalesce("word_count", zero).alias("word_count"),
            factor.alias("real_time_factor"),
        )
    )


def invariant_violations(segments: DataFrame, words: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of a transcript that break its own contract, with every broken rule."""
    seg = running_before(
        segments.join(runs.select("run_id", "duration"), "run_id"), ["run_id"], "index",
        {"before": ("last", F.col("start")), "previous": ("last", F.col("index"))},
    )
    following = F.coalesce(F.col("previous") + 1, F.lit(0))
    seg_rows = seg.select(
        "run_id", "index", F.lit(-1).cast("bigint").alias("word_pos"),
        F.explode(_broken([
            ("index_not_contiguous", F.col("index") != following),
            ("negative_start", F.col("start") < 0),
            ("end_before_start", F.col("end") < F.col("start")),
            ("starts_before_previous", F.col("start") < F.col("before")),
            ("ends_beyond_duration", F.col("end") > F.col("duration")),
        ])).alias("problem"),
    )
    inside = segments.select(
        "run_id", "index", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    word = words.join(inside, ["run_id", "index"]).withColumn("before", F.lag("start").over(
        Window.partitionBy("run_id", "index").orderBy("word_pos")))
    word_rows = word.select(
        "run_id", "index", "word_pos",
        F.explode(_broken([
            ("word_end_before_start", F.col("end") < F.col("start")),
            ("word_outside_segment", (F.col("start") < F.col("seg_start"))
             | (F.col("end") > F.col("seg_end"))),
            ("word_before_previous", F.col("start") < F.col("before")),
        ])).alias("problem"),
    )
    return seg_rows.unionByName(word_rows)


def _broken(named: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in named]), lambda x: x.isNotNull())


def not_rising(rows: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Rows whose value does not exceed that of the row before them: indices of segments in a
    transcript or a chunk, ranks of a shortlist or an index. Scanned in blocks of positions, so a
    long run is not one task."""
    scanned = running_before(rows, keys, position, {"_before": ("last", F.col(value))})
    return scanned.where(F.col(value) <= F.col("_before")).drop("_before")
