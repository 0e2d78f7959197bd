"""Text, SRT and ASS documents out of tables, and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import (
    ass_stamp, caption_safe, half_even_ms, half_up_units, srt_stamp,
)
from cliploom.rules import CaptionStyle

#: Segments per part of a whole-run document.
PART_ROWS = 1000
CLIP = ["run_id", "candidate_id"]


def _parts(rows: DataFrame, line: Column, separator: str) -> DataFrame:
    """(run, part, text): joining the parts in order gives the document.

    A part holds at most PART_ROWS rows, so a very long run never becomes one value.
    """
    entry = F.struct(F.col("index"), line.alias("line"))
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["line"]), separator)
    glue = F.when(F.col("part") > 0, F.lit(separator)).otherwise(F.lit(""))
    return (
        rows.withColumn("part", F.floor(F.col("index") / PART_ROWS))
        .groupBy("run_id", "part").agg(body.alias("text"))
        .withColumn("text", F.concat(glue, "text"))
    )


def transcript_text(segments: DataFrame) -> DataFrame:
    """One line per segment."""
    return _parts(segments, F.concat("text", F.lit("\n")), "")


def transcript_srt(segments: DataFrame) -> DataFrame:
    """SRT from segments; milliseconds are rounded half to even here."""
    block = F.concat(
        (F.col("index") + 1).cast("string"), F.lit("\n"),
        srt_stamp(half_even_ms(F.col("start"))), F.lit(" --> "),
        srt_stamp(half_even_ms(F.col("end"))), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _parts(segments, block, "\n")


def cues_by_clip(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """(CLIP, cues) of every clip out of rows of cues; NULL for a silent one."""
    entry = F.struct("index", "start", "end", "lines")
    return clips.select(*CLIP).join(
        cues.groupBy(*CLIP).agg(F.array_sort(F.collect_list(entry)).alias("cues")), CLIP, "left")


def _once(number: Column, make: Callable[[Column], Column]) -> Column:
    """make(number) with the number computed once, however often it is looked at."""
    return F.transform(F.array(number), make)[0]


def srt_documents(clips: DataFrame) -> DataFrame:
    """SRT of every clip (CLIP, cues); a silent clip has an empty document."""
    def block(c: Column) -> Column:
        return F.concat(
            c["index"].cast("string"), F.lit("\n"), _once(half_up_units(c["start"], 1000), srt_stamp),
            F.lit(" --> "), _once(half_up_units(c["end"], 1000), srt_stamp), F.lit("\n"),
            F.array_join(c["lines"], "\n"))

    body = F.concat(F.array_join(F.transform("cues", block), "\n\n"), F.lit("\n"))
    return clips.select(
        *CLIP, F.when(F.size("cues") > 0, body).otherwise(F.lit("")).alias("document"))


def clip_srt(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """SRT of every clip out of rows of cues."""
    return srt_documents(cues_by_clip(cues, clips))


def ass_header(width: int, height: int, style: CaptionStyle) -> str:
    look = ",".join((
        style.name, style.font, str(style.size), style.primary, style.primary,
        style.outline_colour, style.back, "-1" if style.bold else "0", "0", "0", "0", "100",
        "100", "0", "0", "1", style.outline, style.shadow, str(style.alignment),
        str(style.margin_horizontal), str(style.margin_horizontal), str(style.margin_vertical),
        "1",
    ))
    return "\n".join((
        *rules.ASS_SCRIPT_INFO, f"PlayResX: {width}", f"PlayResY: {height}", "",
        "[V4+ Styles]", f"Format: {rules.ASS_STYLE_FORMAT}", f"Style: {look}", "",
        "[Events]", f"Format: {rules.ASS_EVENT_FORMAT}",
    ))


def ass_documents(clips: DataFrame, width: int, height: int, style: CaptionStyle = CaptionStyle()
                  ) -> DataFrame:
    """ASS of every clip (CLIP, cues); a silent clip holds the header alone."""
    def line(c: Column) -> Column:
        return F.concat(
            F.lit("\nDialogue: 0,"), _once(half_up_units(c["start"], 100), ass_stamp), F.lit(","),
            _once(half_up_units(c["end"], 100), ass_stamp), F.lit(f",{style.name},,0,0,0,,"),
            F.array_join(F.transform(c["lines"], caption_safe), "\\N"))

    body = F.coalesce(F.array_join(F.transform("cues", line), ""), F.lit(""))
    return clips.select(*CLIP, F.concat(
        F.lit(ass_header(width, height, style)), body, F.lit("\n")).alias("document"))


def clip_ass(cues: DataFrame, clips: DataFrame, width: int, height: int,
             style: CaptionStyle = CaptionStyle()) -> DataFrame:
    """ASS of every clip out of rows of cues."""
    return ass_documents(cues_by_clip(cues, clips), width, height, style)


def _clock(hours: Column, minutes: Column, seconds: Column, rest: Column, unit_ms: int) -> Column:
    """Milliseconds from digit texts; anything else gives NULL."""
    h, m, s, r = (x.try_cast("bigint") for x in (hours, minutes, seconds, rest))
    return ((h * 60 + m) * 60 + s) * 1000 + r * unit_ms


def _outcome(docs: DataFrame, events: Column) -> DataFrame:
    """Attach events and the first problem; a document is read whole or refused whole.

    The events go through a one-row explode: later filters on ``problem`` then read the parsed
    column instead of parsing again.
    """
    return docs.withColumn("events", F.explode(F.array(events))).withColumn(
        "problem",
        F.get(F.filter(F.transform("events", lambda e: e["problem"]),
                       lambda p: p.isNotNull()), F.lit(0)),
    )


def _with(rows: Column, names: list[str], **more: Callable[[Column], Column]) -> Column:
    """Add named values to every struct of an array, so later steps read instead of recompute."""
    return F.transform(rows, lambda x: F.struct(
        *[x[n].alias(n) for n in names], *[make(x).alias(n) for n, make in more.items()]))


def _event(x: Column, problem: Column, text: Column) -> Column:
    return F.struct(x["start"].alias("start_ms"), x["end"].alias("end_ms"), text.alias("text"),
                    problem.alias("problem"))


def parse_srt(docs: DataFrame) -> DataFrame:
    """Documents with ``events`` (start_ms, end_ms, text) and ``problem``."""
    both = r"\A\d{2}:\d{2}:\d{2},\d{3} --> \d{2}:\d{2}:\d{2},\d{3}\z"
    blocks = F.filter(
        F.split(F.replace(F.col("document"), F.lit("\r\n"), F.lit("\n")), "\n\n"),
        lambda b: F.trim(b, F.lit(" \t\n\r")) != "")

    def at(x: Column, first: int) -> Column:
        # Fixed width once it matches: two stamps, five characters between.
        digits = [F.substring(x["times"], first + i, n) for i, n in ((0, 2), (3, 2), (6, 2), (9, 3))]
        return F.when(x["ok"], _clock(*digits, 1))

    def event(x: Column) -> Column:
        lines = x["lines"]
        problem = (
            F.when(F.size(lines) < 3, F.lit("no_text"))
            .when(F.trim(F.get(lines, F.lit(0))) != (x["i"] + 1).cast("string"),
                  F.lit("wrong_number"))
            .when(~x["ok"], F.lit("bad_timestamps"))
            .when(x["end"] <= x["start"], F.lit("ends_before_start"))
        )
        text = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
        return _event(x, problem, text)

    rows = F.transform(blocks, lambda b, i: F.struct(
        F.split(F.trim(b, F.lit("\n")), "\n").alias("lines"), i.alias("i")))
    rows = _with(rows, ["lines", "i"],
                 times=lambda x: F.trim(F.coalesce(F.get(x["lines"], F.lit(1)), F.lit(""))))
    rows = _with(rows, ["lines", "i", "times"], ok=lambda x: x["times"].rlike(both))
    rows = _with(rows, ["lines", "i", "ok"], start=lambda x: at(x, 1), end=lambda x: at(x, 18))
    return _outcome(docs, F.transform(rows, event))


def parse_ass(docs: DataFrame) -> DataFrame:
    """Same for the Dialogue lines of ASS documents."""
    stamp = r"\A(\d+):(\d{2}):(\d{2})\.(\d{2})\z"
    lines = F.filter(
        F.split(F.replace(F.col("document"), F.lit("\r\n"), F.lit("\n")), "\n"),
        lambda x: x.startswith("Dialogue:"))

    def field(x: Column, i: int) -> Column:
        return F.trim(F.coalesce(F.get(x["fields"], F.lit(i)), F.lit("")))

    def at(x: Column, name: str) -> Column:
        parts = F.split(x[name], "[:.]")
        return F.when(x["ok"], _clock(*[F.get(parts, F.lit(i)) for i in range(4)], 10))

    def event(x: Column) -> Column:
        problem = (
            F.when(F.size(x["fields"]) != 10, F.lit("wrong_fields"))
            .when(~x["ok"], F.lit("bad_timestamps"))
            .when(x["end"] <= x["start"], F.lit("ends_before_start"))
        )
        text = F.replace(F.get(x["fields"], F.lit(9)), F.lit("\\N"), F.lit("\n"))
        return _event(x, problem, text)

    rows = F.transform(lines, lambda line: F.struct(
        F.split(F.substring(line, 10, 2147483647), ",", 10).alias("fields")))
    rows = _with(rows, ["fields"], left=lambda x: field(x, 1), right=lambda x: field(x, 2))
    rows = _with(rows, ["fields", "left", "right"],
                 ok=lambda x: x["left"].rlike(stamp) & x["right"].rlike(stamp))
    rows = _with(rows, ["fields", "ok"], start=lambda x: at(x, "left"),
                 end=lambda x: at(x, "right"))
    return _outcome(docs, F.transform(rows, event))


def events_of(parsed: DataFrame) -> DataFrame:
    """Event rows of the accepted documents."""
    return parsed.where("problem IS NULL").select(
        *CLIP, F.posexplode("events").alias("position", "event")
    ).select(
        *CLIP, (F.col("position") + 1).cast("bigint").alias("position"), "event.start_ms",
        "event.end_ms", "event.text")


def event_problems(parsed: DataFrame, clips: DataFrame) -> DataFrame:
    """First problem of a document against its clip: unreadable, out of order, past the end."""
    limit = F.rint((F.col("end") - F.col("start")) * 1000).cast("bigint")
    early = F.filter(F.transform("events", lambda e, i: F.when(
        e["start_ms"] < F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("events", i - 1)["end_ms"]), i)),
        lambda i: i.isNotNull())
    # Only what a document comes to meets its clip: the first event out of order, and how far those
    # before it reach.
    marked = parsed.select(*CLIP, "problem", "events", F.get(early, F.lit(0)).alias("_early")).select(
        *CLIP, "problem", "_early", F.array_max(F.transform(
            F.slice("events", 1, F.coalesce("_early", F.size("events"))), lambda e: e["end_ms"])).alias("_reach"))
    return marked.join(clips.select(*CLIP, limit.alias("limit_ms")), CLIP).select(
        *CLIP, F.when(F.col("problem").isNotNull(), F.lit("unreadable"))
        .when(F.col("_reach") > F.col("limit_ms"), F.lit("past_clip_end"))
        .when(F.col("_early").isNotNull(), F.lit("out_of_order")).alias("problem"))
