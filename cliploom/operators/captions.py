"""From words and clips to caption cues.

Lines meet clips in tiles of a run's time, and every clip finds its words there: a line is shuffled
once, as a text, and no word is. What follows is done in the row of a clip: its words are one array,
ordered by time, and the two real recurrences (how many words fit, when a cue may start) are folds
over it, which keep finished cues and the open one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import collapse_spaces
from cliploom.rules import CaptionRules

CLIP = ["run_id", "candidate_id"]
BUCKET_SECONDS = 60.0


def _minutes(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / BUCKET_SECONDS), F.floor(end / BUCKET_SECONDS))


def _clips_of_segments(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(run_id, seg_index, clips): the clips that share time with a segment."""
    start, end = F.col("_start"), F.col("_end")
    once = F.col("minute") == F.greatest(
        F.floor(start / BUCKET_SECONDS), F.floor(F.col("clip_start") / BUCKET_SECONDS))
    return (
        segments.select("run_id", F.col("index").alias("seg_index"), F.col("start").alias("_start"),
                        F.col("end").alias("_end"))
        .withColumn("minute", F.explode(_minutes(start, end))).join(spans, ["run_id", "minute"])
        .where(once & (end - F.col("clip_start") > rules.CAPTION_EPSILON)
               & (F.col("clip_end") - start > rules.CAPTION_EPSILON))
        .groupBy("run_id", "seg_index").agg(F.collect_list(
            F.struct("candidate_id", "clip_start", "clip_end")).alias("clips"))
    )


def clip_words(words: DataFrame, clips: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Words sharing time with a clip, clamped to it and counted from its start.

    With ``segments``, out of which no word reaches, clips go to the segments they share time with
    and on to the words of these, which stay where they are."""
    return _from_clip_start(_heard(words, clips, segments))


def _heard(words: DataFrame, clips: DataFrame, segments: DataFrame | None) -> DataFrame:
    eps = rules.CAPTION_EPSILON
    spans = clips.select(
        *CLIP, F.col("start").alias("clip_start"), F.col("end").alias("clip_end")
    ).withColumn("minute", F.explode(_minutes(F.col("clip_start"), F.col("clip_end"))))
    if segments is None:
        spoken = words.withColumn("minute", F.explode(_minutes(F.col("start"), F.col("end"))))
        met = spoken.join(spans, ["run_id", "minute"])
    else:
        met = words.join(_clips_of_segments(segments, spans), ["run_id", "seg_index"]).select(
            *words.columns, F.inline("clips"))
    once = F.lit(True) if segments is not None else F.col("minute") == F.greatest(
        F.floor(F.col("start") / BUCKET_SECONDS), F.floor(F.col("clip_start") / BUCKET_SECONDS))
    return (
        met.where(
            once & (F.col("end") - F.col("clip_start") > eps)
            & (F.col("clip_end") - F.col("start") > eps)
        )
        .withColumn("text", collapse_spaces(F.col("word")))
        .where("text <> ''")
        .select(*CLIP, "clip_start", "clip_end", "seg_index", "word_pos", "text",
                F.col("start").alias("abs_start"), F.col("end").alias("abs_end"))
    )


def _gathered(heard: DataFrame) -> DataFrame:
    """Words brought together by clip. What a clip takes of one segment stands in one task before,
    so it is shuffled as one row."""
    part = [*CLIP, "clip_start", "clip_end", "seg_index"]
    word = F.struct("word_pos", "text", "abs_start", "abs_end")
    return heard.groupBy(*part).agg(F.collect_list(word).alias("_words")).repartition(*CLIP).select(
        *part, F.inline("_words"))


def _from_clip_start(heard: DataFrame, *more: str) -> DataFrame:
    start = F.greatest("abs_start", "clip_start") - F.col("clip_start")
    end = F.least("abs_end", "clip_end") - F.col("clip_start")
    return heard.select(
        *CLIP, *more, "seg_index", "word_pos", "text", "abs_start", "abs_end", start.alias("start"),
        F.greatest(end, start).alias("end"),
        (F.col("clip_end") - F.col("clip_start")).alias("clip_length"),
    )


#: The words of a clip in order, side by side: their texts, absolute times, segments and positions.
WORDS = ["texts", "starts", "ends", "segments", "places"]

#: Signs after which a cue ends or may end, and those that may follow them.
_SIGNS = rules.SENTENCE_END + rules.SOFT_BREAK

#: Seconds of a tile: lines and the clips that start in it meet in one task.
TILE = 1800.0
#: Seconds by which lines are dealt further than they must, for rounding.
SLACK = 1e-3


def words_of_clips(heard: DataFrame) -> DataFrame:
    """(CLIP, clip_start, clip_end, WORDS) out of rows of words, by time, then transcript order."""
    order = F.struct("abs_start", "abs_end", "seg_index", "word_pos", "text")
    rows = heard.groupBy(*CLIP, "clip_start", "clip_end").agg(
        F.sort_array(F.collect_list(order)).alias("_words"))
    return rows.select(*CLIP, "clip_start", "clip_end", *[
        F.col(f"_words.{field}").alias(name)
        for name, field in zip(WORDS, ("text", "abs_start", "abs_end", "seg_index", "word_pos"), strict=True)])


def lines_to_clips(lines: DataFrame, clips: DataFrame, taken: Callable[[DataFrame], DataFrame],
                   parts: int | None = None) -> DataFrame:
    """(CLIP, clip_start, clip_end, WORDS) out of lines (run_id, seg_index, start, end and what
    ``taken`` reads) that follow one another and out of which no word reaches; a clip without words
    has empty arrays. ``taken`` adds texts, starts, ends and places of the words that share time with
    a clip (clip_start, clip_end) to rows of lines with one, without blank words; it may drop rows.

    A clip lies in the tile in which it starts, a line in every tile that has clips which may reach
    it: most lines in one. ``parts``: into how many tasks tiles are dealt."""
    reach, lowest = clips.agg(
        F.coalesce(F.max(F.col("end") - F.col("start")), F.lit(0.0)),
        F.coalesce(F.min("start"), F.lit(0.0))).first()
    width = max(TILE, reach)
    deal = [F.col("run_id"), F.col("tile")]
    first = F.floor(F.greatest(F.col("start") - (reach + SLACK), F.lit(lowest)) / width)
    dealt = lines.where(F.col("end") >= lowest).withColumn("tile", F.explode(F.sequence(
        first, F.greatest(first, F.floor((F.col("end") + SLACK) / width)))))
    own = clips.select(*CLIP, F.col("start").alias("clip_start"), F.col("end").alias("clip_end"),
                       F.floor(F.col("start") / width).alias("tile"))
    dealt, own = (x.repartition(*deal) if parts is None else x.repartition(parts, *deal)
                  for x in (dealt, own))
    there = dealt.withColumnsRenamed({"run_id": "_run", "tile": "_tile"})
    near = ((F.col("run_id") == F.col("_run")) & (F.col("tile") == F.col("_tile"))
            & (F.col("end") - F.col("clip_start") > rules.CAPTION_EPSILON)
            & (F.col("clip_end") - F.col("start") > rules.CAPTION_EPSILON))
    key = [*CLIP, "tile", "clip_start", "clip_end"]
    piece = F.struct(F.get("starts", F.lit(0)).alias("at"), "seg_index", "texts", "starts", "ends", "places")
    pieces = taken(own.join(there, near).drop("_run", "_tile")).select(*key, piece.alias("piece"))
    silent = own.select(*key, F.lit(None).cast(pieces.schema["piece"].dataType).alias("piece"))
    met = pieces.unionByName(silent).groupBy(*key).agg(
        F.sort_array(F.collect_list("piece")).alias("pieces"))
    own_segments = F.transform("pieces", lambda p: F.array_repeat(p["seg_index"], F.size(p["texts"])))
    return met.select(*CLIP, "clip_start", "clip_end", *[
        F.flatten(own_segments if name == "segments" else F.col(f"pieces.{name}")).alias(name)
        for name in WORDS])


def tokens_of(clips: DataFrame) -> DataFrame:
    """Rows of the words of clips, clamped and counted from its start, with their position from 1."""
    rows = clips.select(*CLIP, "clip_start", "clip_end", F.posexplode(F.arrays_zip(*WORDS)).alias("_at", "_w"))
    return _from_clip_start(rows.select(
        *CLIP, "clip_start", "clip_end", (F.col("_at") + 1).cast("bigint").alias("token_pos"),
        *[F.col(f"_w.{w}").alias(name) for w, name in zip(
            WORDS, ("text", "abs_start", "abs_end", "seg_index", "word_pos"), strict=True)]), "token_pos")


def named(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later steps read; by a one-row explode, or they would compute it again."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _counted(clips: DataFrame) -> DataFrame:
    """begins and stops: the times of words, clamped to their clip and counted from its start."""
    clip_start, clip_end = F.col("clip_start"), F.col("clip_end")
    begins = named(clips, "begins", F.transform(
        "starts", lambda t: F.greatest(t, clip_start) - clip_start))
    return named(begins, "stops", F.zip_with(
        "ends", "begins", lambda t, begin: F.greatest(F.least(t, clip_end) - clip_start, begin)))


def _sign(word: str) -> str:
    """Where in _SIGNS the last sign of a word stands once closing quotes and brackets are gone, from
    1; 0 if it does not."""
    closing = rules.CLOSING_MARKS.replace("'", "\\'")
    bare = f"rtrim('{closing}', {word})"
    return (f"IF(instr('{closing}', substring({word}, -1, 1)) = 0, "
            f"instr('{_SIGNS}', substring({word}, -1, 1)), "
            f"IF({bare} = '', 0, instr('{_SIGNS}', substring({bare}, -1, 1))))")


def hard_breaks(clips: DataFrame, cue: CaptionRules = CaptionRules()) -> DataFrame:
    """Number the stretches between sentence ends and pauses: (CLIP, token_pos, stretch)."""
    broken = (f"CAST(s.sign BETWEEN 1 AND {len(rules.SENTENCE_END)} OR (s.at > 0 "
              f"AND get(begins, s.at) - get(stops, s.at - 1) >= {cue.pause_seconds}D) AS bigint)")
    fold = f"""aggregate(texts, named_struct('k', 0L, 'sign', 0, 'at', 0, 'out', CAST(array() AS array<bigint>)),
        (s, w) -> named_struct('k', s.k + {broken}, 'sign', {_sign("w")}, 'at', s.at + 1,
            'out', array_append(s.out, s.k + {broken})),
        s -> s.out)"""
    return _counted(clips).select(
        *CLIP, F.posexplode(F.expr(fold)).alias("_at", "stretch"),
    ).select(*CLIP, (F.col("_at") + 1).cast("bigint").alias("token_pos"), "stretch")


def group_words(clips: DataFrame, cue: CaptionRules = CaptionRules()) -> DataFrame:
    """(CLIP, clip_length, groups): greedy cues (raw_start, raw_end, limit, words) in order, where
    limit is the raw start of the next one or the clip's end.

    A cue is closed after a sentence, before a pause, and when no further word fits. The fold keeps
    where cues start; n and size are the words and signs of the open one."""
    step = f"'sign', {_sign('w')}, 'at', s.at + 1"
    fold = f"""aggregate(texts,
        named_struct('n', 0, 'size', 0, 'sign', 0, 'at', 0, 'cuts', CAST(array() AS array<int>)),
        (s, w) -> IF(s.n = 0 OR s.n >= {cue.max_words}
                OR (s.sign > 0 AND (s.sign <= {len(rules.SENTENCE_END)} OR s.n >= {cue.soft_break_words}))
                OR s.size + 1 + length(w) > {cue.max_cue_chars}
                OR get(begins, s.at) - get(stops, s.at - 1) >= {cue.pause_seconds}D,
            named_struct('n', 1, 'size', length(w), {step}, 'cuts', array_append(s.cuts, s.at)),
            named_struct('n', s.n + 1, 'size', s.size + 1 + length(w), {step}, 'cuts', s.cuts)),
        s -> s.cuts)"""

    def group(cut: Column, i: Column) -> Column:
        following = F.get("cuts", i + 1)
        n = F.coalesce(following, F.size("texts")) - cut
        return F.struct(
            F.get("begins", cut).alias("raw_start"),
            F.array_max(F.slice("stops", cut + 1, n)).alias("raw_end"),
            F.coalesce(F.get("begins", following), F.col("clip_length")).alias("limit"),
            F.slice("texts", cut + 1, n).alias("words"))

    length = (F.col("clip_end") - F.col("clip_start")).alias("clip_length")
    cut = named(_counted(clips), "cuts", F.expr(fold)).select(*CLIP, length, "texts", "begins", "stops", "cuts")
    return named(cut, "groups", F.transform("cuts", group)).select(*CLIP, "clip_length", "groups")


def time_cues(grouped: DataFrame, cue: CaptionRules = CaptionRules()) -> DataFrame:
    """(CLIP, cues): ordered, visible, inside the clip; what cannot be shown is dropped. A cue is
    (index, start, end, lines)."""
    eps = f"{rules.CAPTION_EPSILON}D"
    # x is the cue before; one-element transforms name numbers, so each is computed once.
    prev = f"IF(s.x.e - s.x.b > {eps}, s.x.e, s.prev)"
    fold = f"""aggregate(groups,
        named_struct('prev', 0.0D, 'x', named_struct('b', 0.0D, 'e', 0.0D), 'times', CAST(array() AS array<double>)),
        (s, c) -> named_struct('prev', {prev}, 'x', transform(transform(
                array(least(greatest(c.raw_start, {prev}), clip_length)),
                b -> named_struct('b', b, 'e', least(greatest(c.raw_end, b), clip_length))),
                x -> named_struct('b', x.b, 'e', IF(x.e - x.b < {cue.min_cue_seconds}D,
                    least(x.b + {cue.min_cue_seconds}D, least(greatest(c.limit, x.b), clip_length)), x.e)))[0],
            'times', concat(s.times, array(s.x.b, s.x.e))),
        s -> concat(s.times, array(s.x.b, s.x.e)))"""

    def timed(group: Column, i: Column) -> Column:
        return F.struct(F.get("times", 2 * i + 2).alias("start"), F.get("times", 2 * i + 3).alias("end"),
                        group["words"].alias("words"))

    shown = F.filter(F.transform("groups", timed),
                     lambda c: c["end"] - c["start"] > rules.CAPTION_EPSILON)
    return named(grouped, "times", F.expr(fold)).select(*CLIP, F.transform(shown, lambda c, i: F.struct(
        (i + 1).cast("bigint").alias("index"), c["start"].alias("start"), c["end"].alias("end"),
        wrap_lines(c["words"], cue).alias("lines"))).alias("cues"))


def wrap_lines(words: Column, cue: CaptionRules = CaptionRules()) -> Column:
    """One line, or two split where the longer one is shortest (first such split)."""
    joined = F.array_join(words, " ")
    one = F.array(joined)
    if cue.max_lines == 1:
        return one
    n = F.size(words)

    def step(s: Column, w: Column) -> Column:
        size = s["size"] + 1 + F.length(w)
        cost = F.greatest(size, s["whole"] - size - 1)
        at = (s["at"] + 1).alias("at")
        better = cost < s["cost"]
        return F.struct(s["whole"].alias("whole"), at, size.alias("size"),
                        F.when(better, cost).otherwise(s["cost"]).alias("cost"),
                        F.when(better, at).otherwise(s["cut"]).alias("cut"))

    # All words on the first line cost the most, so the last step changes nothing.
    start = F.struct(F.length(joined).alias("whole"), F.lit(0).alias("at"), F.lit(-1).alias("size"),
                     F.lit(2147483647).alias("cost"), F.lit(0).alias("cut"))
    best = F.aggregate(words, start, step, lambda s: s["cut"])
    two = F.transform(F.array(best), lambda at: F.array(
        F.array_join(F.slice(words, F.lit(1), at), " "), F.array_join(F.slice(words, at + 1, n), " ")))[0]
    return F.when((F.length(joined) <= cue.max_line_chars) | (n == 1), one).otherwise(two)


def cues_of_clips(clips: DataFrame, cue: CaptionRules = CaptionRules()) -> DataFrame:
    """(CLIP, cues) of clips with their words."""
    return time_cues(group_words(clips, cue), cue)


def build_cues(words: DataFrame, clips: DataFrame, cue: CaptionRules = CaptionRules(),
               segments: DataFrame | None = None) -> DataFrame:
    """(run, candidate, index, start, end, lines)"""
    heard = _heard(words, clips, segments)
    if segments is not None:
        heard = _gathered(heard)
    return cues_of_clips(words_of_clips(heard), cue).select(*CLIP, F.inline("cues"))
