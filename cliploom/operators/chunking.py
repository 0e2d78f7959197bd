"""Overlapping windows over a transcript.

A segment knows by arithmetic which windows it overlaps, so no segment x window join is
needed. Whether a window repeats the one before it is decided from one number per window:
the windows of a segment are consecutive, so a window adds nothing exactly when its
latest-starting segment already reached the window before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.functions.columns import fixed2
from cliploom.rules import Policy


def _left_pad(text: Column, width: int) -> Column:
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def chunk_line(start: Column, end: Column, text: Column) -> Column:
    """``[  start -->     end] text`` with two decimals, nine wide."""
    return F.concat(
        F.lit("["), _left_pad(fixed2(start), 9), F.lit(" --> "), _left_pad(fixed2(end), 9),
        F.lit("] "), text,
    )


def window_segments(segments: DataFrame, runs: DataFrame, policy: Policy,
                    grid: tuple[Column, Column] | None = None) -> DataFrame:
    """(run, window k, segment) for every segment sharing time with window k (strictly). ``grid``
    gives each segment row its own stride and width instead of the policy's."""
    stride, width = grid or (F.lit(policy.stride), F.lit(policy.window_seconds))
    first = F.greatest(F.floor((F.col("start") - width) / stride) - 1, F.lit(0))
    last = F.greatest(F.ceil(F.col("end") / stride) + 1, F.lit(0))
    k = F.col("window_k")
    placed = (
        segments.join(runs.select("run_id", "duration"), "run_id")
        .withColumn("window_k", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        .withColumn("window_start", k * stride)
        .withColumn("window_end", k * stride + width)
        .where(
            (F.col("end") > F.col("window_start"))
            & (F.col("start") < F.col("window_end"))
            & (F.col("window_start") < F.col("duration"))
        )
    )
    return placed.withColumn(
        "first_k",
        F.greatest(F.lit(0), F.floor((F.col("start") - width) / stride) + 1).cast("bigint"),
    )


def _numbered(per_window: DataFrame, skip_covered: bool, keys: tuple[str, ...] = ("run_id",)
              ) -> DataFrame:
    """Number the emitted windows; ordering spans windows of one run, bounded by its length."""
    order = Window.partitionBy(*keys).orderBy("window_k")
    marked = per_window.withColumn("_before", F.lag("window_k").over(order)).withColumn(
        "_covered", F.coalesce(F.col("latest_first_k") <= F.col("_before"), F.lit(False))
    )
    if skip_covered:
        kept = marked.where(~F.col("_covered"))
    else:
        # The first window that repeats its predecessor ends the run's chunking.
        seen = F.max(F.col("_covered").cast("int")).over(
            order.rowsBetween(Window.unboundedPreceding, 0)
        )
        kept = marked.withColumn("_stopped", seen).where(F.col("_stopped") == 0)
    return kept.withColumn(
        "chunk_index", (F.row_number().over(order) - 1).cast("bigint")
    ).withColumn("chunk_id", chunk_name(F.col("chunk_index"))).drop(
        "_before", "_covered", "_stopped", "latest_first_k"
    )


def chunk_name(index: Column) -> Column:
    return F.format_string("chunk_%04d", index)


def chunk_extents(
    segments: DataFrame, runs: DataFrame, policy: Policy, skip_covered: bool = False
) -> DataFrame:
    """Chunks without their text: what placement and validation need."""
    per_window = (
        window_segments(segments, runs, policy)
        .groupBy("run_id", "window_k", "window_start", "window_end", "duration")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.count("*").alias("segment_count"), F.max("first_k").alias("latest_first_k"),
        )
    )
    return _numbered(per_window, skip_covered)


def chunk_extents_by_grid(segments: DataFrame, runs: DataFrame,
                          grids: dict[str, tuple[float, float]]) -> DataFrame:
    """chunk_extents under several (stride, width) at once, keyed by (grid_id, run_id): one pass
    over the segments, each of which is repeated once per grid."""
    table = F.array(*[F.struct(F.lit(name).alias("grid_id"), F.lit(float(stride)).alias("stride"),
                               F.lit(float(width)).alias("width"))
                      for name, (stride, width) in grids.items()])
    placed = window_segments(
        segments.select("run_id", "start", "end", F.inline(table)), runs, Policy(),
        (F.col("stride"), F.col("width")))
    keys = ("grid_id", "run_id")
    per_window = placed.groupBy(*keys, "window_k", "window_start", "window_end", "duration").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.count("*").alias("segment_count"), F.max("first_k").alias("latest_first_k"))
    return _numbered(per_window, False, keys)


def build_chunks(
    segments: DataFrame, runs: DataFrame, policy: Policy, skip_covered: bool = False
) -> DataFrame:
    """Chunks with ordered segment indices and rendered text.

    One chunk is one document sent to an analyzer: its size is set by the window length,
    so the ordered collect below is bounded by the window, not by the run.
    """
    line = F.struct(
        F.col("index"), chunk_line(F.col("start"), F.col("end"), F.col("text")).alias("line")
    )
    per_window = (
        window_segments(segments, runs, policy)
        .groupBy("run_id", "window_k", "window_start", "window_end", "duration")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.max("first_k").alias("latest_first_k"),
            F.array_sort(F.collect_list(line)).alias("_lines"),
        )
    )
    return _numbered(per_window, skip_covered).select(
        "run_id", "chunk_id", "chunk_index", "window_k", "window_start", "window_end",
        "start", "end",
        F.transform("_lines", lambda r: r["index"]).alias("segment_indices"),
        F.array_join(F.transform("_lines", lambda r: r["line"]), "\n").alias("text"),
    )


def chunk_segments(segments: DataFrame, runs: DataFrame, policy: Policy) -> DataFrame:
    """Bridge rows (run, chunk, segment)."""
    chunks = chunk_extents(segments, runs, policy).select("run_id", "window_k", "chunk_id")
    return (
        window_segments(segments, runs, policy)
        .select("run_id", "window_k", "index")
        .join(chunks, ["run_id", "window_k"])
        .select("run_id", "chunk_id", F.col("index").alias("seg_index"))
    )
