"""Probe documents of media files, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.columns import first_problem, is_finite
from cliploom.functions.json import shape_problem

_STREAM = ("codec_type", "codec_name", "width", "height", "sample_rate", "channels",
           "avg_frame_rate", "r_frame_rate", "sample_aspect_ratio", "duration")
_SCHEMA = ("struct<streams:array<struct<" + ",".join(f"{n}:string" for n in _STREAM)
           + ">>,format:struct<duration:string,format_name:string>>")


def _rate(text: Column) -> Column:
    """A positive rate from ``a/b`` or a plain number, else NULL."""
    parts = F.split(F.trim(text), "/")
    top = F.get(parts, F.lit(0)).try_cast("double")
    low = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    value = F.when(F.size(parts) <= 2, F.try_divide(top, low))
    return F.when((value > 0) & is_finite(value), value)


def _first_stream(kind: str) -> Column:
    return F.get(F.filter("_d.streams", lambda s: s["codec_type"] == kind), F.lit(0))


def _full(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", text)


def probe_media(docs: DataFrame, text: str = "document") -> DataFrame:
    """Measured facts of every document, and ``problem`` where it cannot be used."""
    c = F.col
    parsed = docs.withColumn("_d", F.from_json(c(text), _SCHEMA))
    for kind in ("video", "audio"):
        parsed = parsed.withColumn(f"_{kind}", _first_stream(kind))
    stated = F.coalesce(_full(c("_d.format.duration")), _full(c("_video.duration")))
    ratio = F.trim(c("_video.sample_aspect_ratio"))
    number = {n: c(f"_{s}.{n}").try_cast("bigint")
              for s, n in (("video", "width"), ("video", "height"), ("audio", "sample_rate"),
                           ("audio", "channels"))}
    unread = F.lit(False)
    for n in ("sample_rate", "channels"):
        unread = unread | (_full(c(f"_audio.{n}")).isNotNull() & number[n].isNull())
    out = parsed.withColumn("duration_seconds", stated.try_cast("double"))
    length = c("duration_seconds")
    return out.withColumns({
        "problem": first_problem([
            ("not_json", shape_problem(c(text)).isNotNull() | c("_d").isNull()),
            ("no_video", c("_video").isNull()),
            ("no_audio", c("_audio").isNull()),
            ("no_duration", length.isNull()),
            ("duration_not_finite", ~is_finite(length)),
            ("duration_not_positive", length <= 0),
            ("incomplete", c("_video.codec_name").isNull() | number["width"].isNull()
             | number["height"].isNull() | unread),
        ]),
        "video_codec": c("_video.codec_name"), "audio_codec": c("_audio.codec_name"),
        **number,
        "fps": F.coalesce(_rate(c("_video.avg_frame_rate")), _rate(c("_video.r_frame_rate")),
                          F.lit(0.0)),
        "sample_aspect_ratio": F.when(~ratio.isin("", "N/A", "0:1"), ratio),
        "container": F.coalesce(c("_d.format.format_name"), F.lit("unknown")),
    }).drop("_d", "_video", "_audio")
