"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cliploom import rules


def collapse_spaces(text: Column) -> Column:
    """Every run of Unicode white space becomes one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f\x{85}]+", " "))


def is_blank(text: Column) -> Column:
    return collapse_spaces(text) == ""


def is_finite(value: Column) -> Column:
    """Neither NaN nor an infinity (NULL counts as finite: nothing was stated)."""
    return F.coalesce(~(F.isnan(value) | (F.abs(value) == F.lit(float("inf")))), F.lit(True))


def close(a: Column, b: Column, epsilon: float = rules.TIME_EPSILON) -> Column:
    return F.abs(a - b) <= F.lit(epsilon)


def ms(seconds: Column) -> Column:
    """Seconds that came from whole milliseconds, back to whole milliseconds."""
    return F.round(seconds * 1000).cast("bigint")


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; touching intervals give 0."""
    overlap = F.least(e1, e2) - F.greatest(s1, s2)
    union = (e1 - s1) + (e2 - s2) - overlap
    return F.when(overlap <= 0, F.lit(0.0)).otherwise(overlap / union)


def half_up_units(seconds: Column, units: int) -> Column:
    """Whole units from seconds, ties away from zero on the shortest decimal, never below 0.

    Only near a tie does the decimal decide; anywhere else the product rounds to the same."""
    exact = seconds.cast("string").cast("decimal(28,12)") * F.lit(units)
    product = seconds * F.lit(float(units))
    sure = (F.abs(product - F.floor(product) - 0.5) > 1e-4) & (F.abs(product) < 1e9)
    return F.greatest(F.lit(0).cast("bigint"), F.when(sure, F.floor(product + 0.5).cast("bigint"))
                      .otherwise(F.round(exact).cast("bigint")))


def half_even_ms(seconds: Column) -> Column:
    """Whole milliseconds from the float product, ties to even, never below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.rint(seconds * 1000).cast("bigint"))


def _pad(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def _digits(value: Column, width: int) -> Column:
    """A number below 10 ** width with its leading zeros."""
    return F.substring((value + F.lit(10 ** width)).cast("string"), 2, width)


def srt_stamp(millis: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.concat(
        _pad(F.floor(millis / 3_600_000), 2), F.lit(":"),
        _digits(F.floor(millis / 60_000) % 60, 2), F.lit(":"),
        _digits(F.floor(millis / 1000) % 60, 2), F.lit(","), _digits(millis % 1000, 3),
    )


def ass_stamp(centis: Column) -> Column:
    """H:MM:SS.cc"""
    return F.concat(
        F.floor(centis / 360_000).cast("string"), F.lit(":"),
        _digits(F.floor(centis / 6000) % 60, 2), F.lit(":"),
        _digits(F.floor(centis / 100) % 60, 2), F.lit("."), _digits(centis % 100, 2),
    )


def fixed2(seconds: Column) -> Column:
    """Two decimals as C prints them: rounded from the binary value, not from its decimal text.

    Only a value whose thousandths round to a lone 5 can differ between the two. On which side
    of that midpoint it lies is the exact sign of ``value * 1000 - midpoint``, which an
    error-free product gives.
    """
    product = seconds * 1000.0
    whole = F.rint(product)
    high = seconds * 134217729.0 - (seconds * 134217729.0 - seconds)
    low = seconds - high
    error = (high * 1000.0 - product) + low * 1000.0
    side = (product - whole) + error
    down = F.floor(whole / 10)
    up = down + 1
    even = F.when(down % 2 == 0, down).otherwise(up)
    centis = (
        F.when(F.abs(whole % 10) != 5, F.rint(seconds * 100.0).cast("bigint"))
        .when(side > 0, up).when(side < 0, down).otherwise(even)
    )
    size = F.abs(centis)
    sign = F.when(centis < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(
        sign, F.floor(size / 100).cast("string"), F.lit("."), _pad(size % 100, 2)
    )


def caption_safe(text: Column) -> Column:
    """Braces and backslashes mean something in an ASS text field; they are transliterated."""
    return F.translate(text, "{}\\", "()/")


def reasons(named: Sequence[tuple[str, Column]]) -> Column:
    """Every reason that applies, in the given order."""
    return F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in named]), lambda r: r.isNotNull()
    )


def first_problem(named: Sequence[tuple[str, Column]]) -> Column:
    """The first reason that applies, or NULL."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in named])


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts in the given order; a NULL part is kept apart from an empty one."""
    return F.sha2(
        F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), 256
    )


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def is_utc_stamp(text: Column) -> Column:
    """A timestamp text that states UTC and can be read."""
    return (text.endswith("Z") | text.endswith("+00:00")) & F.try_to_timestamp(text).isNotNull()


def safe_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))
