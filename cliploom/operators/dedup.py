"""Greedy removal of overlapping candidates, run by run, in parallel over the time of a run.

Candidates are visited best first; one is dropped when an already kept one overlaps it at or
above the threshold, and the best such keeper is recorded.

Equal intervals share the fate of the best one among them, so copies are folded first, on the map
side. Time is then cut into tiles. What happens to the best TOP open intervals of a tile follows
from these alone, as far as none reaches over a border, so every tile is settled by itself: an
interval is sure to be kept if it conflicts with no better one that is not sure to be dropped. An
interval that reaches over a border is kept if it is free in all its tiles; until then it blocks
those that conflict with it. All intervals that conflict with the newly kept ones are dropped by a
join, and the open rest goes on with wider tiles. The best open interval of a run is settled in
every round, and soon a run is one tile, so rounds follow the logarithm of its length and what fits
into a tile, never the number of candidates.

No task holds more than TOP intervals of a tile: Spark cuts a tile to its best ones before the
shuffle, however many a hot run has.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import overlap_ratio
from cliploom.session import write_stage

#: Seconds of a tile at first, how much wider it gets by round, and intervals that it settles.
TILE, WIDER, TOP = 1800.0, 4, 512
#: Seconds of a slot, in which intervals look up the kept ones near them.
SLOT = 30.0
#: Seconds by which a look-up reaches further than it must, for rounding.
SLACK = 1e-3


class _Cells:
    """Cells in (length band, start) and the cells an interval could conflict with."""

    def __init__(self, threshold: float) -> None:
        self.t = min(1.0, threshold)
        self.ratio = max(1.001, 1 + (1 - self.t) / 2)
        self.step = max(0.001, (1 - self.t * self.ratio) / (1 + self.t))

    def band(self, length: Column) -> Column:
        return F.floor(F.log(length) / math.log(self.ratio)).cast("int")

    def size(self, band: Column) -> Column:
        return F.pow(F.lit(self.ratio), band) * self.step

    def cell(self) -> list[Column]:
        band = self.band(F.col("end") - F.col("start"))
        return [band.alias("band"), F.floor(F.col("start") / self.size(band)).alias("slot")]

    def spread(self, df: DataFrame) -> DataFrame:
        """One row per cell whose intervals could reach the threshold against this row."""
        length = F.col("end") - F.col("start")
        around = int(math.ceil(-math.log(self.t) / math.log(self.ratio))) + 1
        slack = 1 - self.t + 1e-6
        own = self.band(length)
        banded = df.withColumn("near_band", F.explode(F.sequence(own - around, own + around)))
        size = self.size(F.col("near_band"))
        longest = F.pow(F.lit(self.ratio), F.col("near_band") + 1)
        low = F.floor((F.col("start") - longest * slack) / size)
        high = F.floor((F.col("start") + length * slack) / size)
        return banded.withColumn("near_slot", F.explode(F.sequence(low, high)))


def _conflict(start: Column, end: Column, other_start: Column, other_end: Column, limit: Column
              ) -> Column:
    return overlap_ratio(start, end, other_start, other_end) >= limit


def _fold(rows: Column) -> Column:
    """The rows of a tile, best first, that no better row of the tile rules out or leaves open.

    seen holds what may rule others out: `sure` rows are kept, the others are open."""
    seen_type = "array<struct<start:double,end:double,sure:boolean>>"

    def step(done: Column, x: Column) -> Column:
        # 2: conflicts with a kept row, 1: with an open one
        met = F.aggregate(
            done["seen"], F.lit(0), lambda worst, s: F.greatest(worst, F.when(
                _conflict(s["start"], s["end"], x["start"], x["end"], x["limit"]),
                F.when(s["sure"], 2).otherwise(1)).otherwise(0)))
        return F.transform(F.array(met), lambda m: F.struct(
            F.when(m == 2, done["seen"]).otherwise(F.concat(done["seen"], F.array(F.struct(
                x["start"].alias("start"), x["end"].alias("end"),
                ((m == 0) & ~x["crosses"]).alias("sure"))))).alias("seen"),
            F.when(m > 0, done["free"]).otherwise(
                F.concat(done["free"], F.array(x))).alias("free")))[0]

    start = F.struct(F.array().cast(seen_type).alias("seen"), F.slice(rows, 1, 0).alias("free"))
    return F.aggregate(rows, start, step, lambda done: done["free"])


def _sure(open_rows: DataFrame, keys: list[str], width: float, top: int) -> DataFrame:
    """Open intervals that are sure to be kept: free in every tile in which they lie."""
    first, last = (F.floor(F.col(c) / width) for c in ("start", "end"))
    last = F.greatest(first, last)
    row = F.struct((-F.col("total_score")).alias("priority"), "start", "candidate_id", "end", "limit",
                   (last > first).alias("crosses"), (last - first + 1).alias("tiles"))
    order = Window.partitionBy(*keys, "tile").orderBy(*[f"row.{c}" for c in ("priority", "start", "candidate_id")])
    tiled = open_rows.select(*keys, row.alias("row"), F.explode(F.sequence(first, last)).alias("tile"))
    best = tiled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top)
    free = best.groupBy(*keys, "tile").agg(F.array_sort(F.collect_list("row")).alias("rows")).select(
        *keys, F.explode(_fold(F.col("rows"))).alias("row"))
    whole = free.groupBy(*keys, "row").agg(F.count("*").alias("in")).where("in = row.tiles")
    return whole.select(*keys, "row.start", "row.end", "row.limit",
                        (-F.col("row.priority")).alias("total_score"), "row.candidate_id")


def _beside(kept: DataFrame, longest: DataFrame, keys: list[str]) -> DataFrame:
    """Kept intervals (k_start, k_end, k_score, k_id) in every slot in which an interval that
    conflicts with them may start. The threshold's share of either length lies in both: it starts
    that share of theirs before they end, and at most the rest of its own length before they start;
    its length is at most theirs over the threshold."""
    length = F.col("k_end") - F.col("k_start")
    share = F.least(F.greatest("limit", F.lit(0.0)), F.lit(1.0))
    reach = F.when(F.col("limit") > 0, F.least(
        F.col("longest"), length / F.col("limit"))).otherwise(F.col("longest")) * (1 - share)
    latest = F.greatest(F.col("k_start"), F.col("k_end") - length * share + SLACK)
    slots = F.sequence(
        F.floor((F.col("k_start") - F.greatest(reach, F.lit(0.0)) - SLACK) / SLOT),
        F.floor(latest / SLOT))
    return (
        kept.select(*keys, "limit", F.col("start").alias("k_start"), F.col("end").alias("k_end"),
                    F.col("total_score").alias("k_score"), F.col("candidate_id").alias("k_id"))
        .join(longest, keys).withColumn("slot", F.explode(slots)).drop("longest", "limit")
    )


def settle(spans: DataFrame, keys: list[str], tile: float = TILE, top: int = TOP
           ) -> tuple[DataFrame, DataFrame]:
    """The kept ones of distinct intervals (keys, start, end, limit, total_score, candidate_id),
    and the longest interval of each key."""
    longest = write_stage(
        spans.groupBy(*keys).agg(F.max(F.col("end") - F.col("start")).alias("longest")), "longest")
    # at a threshold of nothing everything conflicts with the best one, wherever it lies
    whole = F.min(F.struct((-F.col("total_score")).alias("p"), "start", "candidate_id", "end", "limit"))
    parts = [
        spans.where("limit <= 0").groupBy(*keys).agg(whole.alias("b"))
        .select(*keys, "b.start", "b.end", "b.limit", (-F.col("b.p")).alias("total_score"),
                "b.candidate_id")]
    rest, width = spans.where("limit > 0"), tile
    while True:
        sure = write_stage(_sure(rest, keys, width, top), "sure", compression="zstd")
        parts.append(sure)
        same = (F.col("start") == F.col("k_start")) & (F.col("end") == F.col("k_end"))
        conflict = _conflict(F.col("k_start"), F.col("k_end"), F.col("start"), F.col("end"), F.col("limit"))
        near = _beside(sure, longest, keys).withColumnsRenamed({k: f"k_{k}" for k in (*keys, "slot")})
        at = [F.col(k) == F.col(f"k_{k}") for k in (*keys, "slot")]
        rest = write_stage(
            rest.withColumn("slot", F.floor(F.col("start") / SLOT))
            .join(near, [*at, same | conflict], "left_anti").drop("slot"), "open", compression="zstd")
        if rest.isEmpty():
            break
        width *= WIDER
    kept = functools.reduce(DataFrame.unionAll, parts)
    return kept, longest


def rank_kept(kept: DataFrame, keys: list[str]) -> DataFrame:
    """kept with priority_rank: 1..n over the kept intervals of a key, best first.

    Intervals of better scores are counted once per score; only those of one score are sorted
    together."""
    better = Window.partitionBy(*keys).orderBy(F.desc("total_score")).rowsBetween(
        Window.unboundedPreceding, -1)
    scores = kept.groupBy(*keys, "total_score").agg(F.count("*").alias("n")).select(
        *keys, "total_score", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys, "total_score").orderBy("start", "candidate_id")
    return kept.join(scores, [*keys, "total_score"]).withColumn(
        "priority_rank", (F.col("before") + F.row_number().over(within)).cast("bigint")).drop("before")


def greedy_dedup(
    candidates: DataFrame,
    threshold: float,
    keys: list[str] | None = None,
    eligible: Column | None = None,
    threshold_column: Column | None = None,
    stored: bool = False,
) -> DataFrame:
    """Every candidate with its keeper (``kept_id``, ``kept_score``, ``iou``; NULL when kept) and
    its ``priority_rank`` among the kept ones of its key (NULL when dropped).

    ``candidates`` holds keys (not null), candidate_id, start, end, total_score; other columns pass
    through. Rows that are not ``eligible`` neither drop nor are dropped. ``threshold_column``
    gives each key its own threshold (a sweep over policies). ``stored``: the candidates are a
    written table, which is cheap to read once more; rows that are not eligible are then not
    shuffled.
    """
    keys = keys or ["run_id"]
    limit = (F.lit(threshold) if threshold_column is None else threshold_column).cast(
        "double") - F.lit(rules.IOU_EPSILON)
    able = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    marked = candidates.withColumn("_able", able)
    best = F.min(F.struct((-F.col("total_score")).alias("p"), F.col("candidate_id").alias("id")))
    spans = write_stage(
        marked.withColumn("limit", limit).where("_able").groupBy(*keys, "start", "end")
        .agg(best.alias("b"), F.first("limit").alias("limit"))
        .select(*keys, "start", "end", "limit", (-F.col("b.p")).cast("double").alias("total_score"),
                F.col("b.id").alias("candidate_id")), "spans", compression="zstd")
    kept, longest = settle(spans, keys)
    first = kept.where("limit <= 0").select(
        *keys, F.struct("total_score", "start", "candidate_id", "end").alias("first"))
    order = F.struct((-F.col("k_score")).alias("p"), "k_start", "k_id", "k_end")
    conflict = _conflict(F.col("k_start"), F.col("k_end"), F.col("start"), F.col("end"), F.col("limit"))
    near = (
        spans.where("limit > 0").withColumn("slot", F.floor(F.col("start") / SLOT))
        .join(_beside(kept.where("limit > 0"), longest, keys), [*keys, "slot"]).where(conflict)
        .groupBy(*keys, "start", "end").agg(F.min(order).alias("k"))
        .select(*keys, "start", "end", F.struct(
            F.col("k.k_id").alias("id"), (-F.col("k.p")).alias("score"), F.col("k.k_start").alias("s"),
            F.col("k.k_end").alias("e")).alias("_k"))
    )
    all_near = near.unionByName(
        spans.where("limit <= 0").join(first, keys).select(*keys, "start", "end", F.struct(
            F.col("first.candidate_id").alias("id"), F.col("first.total_score").alias("score"),
            F.col("first.start").alias("s"), F.col("first.end").alias("e")).alias("_k")))
    ranks = rank_kept(kept, keys).select(*keys, "start", "end", "priority_rank")
    settled = spans.join(all_near, [*keys, "start", "end"], "left").join(
        ranks, [*keys, "start", "end"], "left").select(
        *keys, "start", "end", F.lit(True).alias("_able"), "priority_rank", F.coalesce("_k", F.struct(
            F.col("candidate_id").alias("id"), F.col("total_score").alias("score"),
            F.col("start").alias("s"), F.col("end").alias("e"))).alias("_k"))
    ratio = overlap_ratio(F.col("_k.s"), F.col("_k.e"), F.col("start"), F.col("end"))
    dropped = (F.col("_k.id") != F.col("candidate_id")) & (ratio >= limit)
    at = [*keys, "start", "end", "_able"]
    if stored:
        past = marked.where("NOT _able").withColumns({
            name: F.lit(None).cast(settled.schema[name].dataType) for name in ("priority_rank", "_k")})
        met = marked.where("_able").join(settled, at, "left").unionByName(past)
    else:
        met = marked.join(settled, at, "left")
    return (
        met.withColumn("iou", F.when(dropped, ratio))
        .withColumn("kept_id", F.when(dropped, F.col("_k.id")))
        .withColumn("kept_score", F.when(dropped, F.col("_k.score")))
        .withColumn("priority_rank", F.when(F.col("kept_id").isNull(), F.col("priority_rank")))
        .drop("_k", "_able")
    )


def overlap_partners(candidates: DataFrame, threshold: float, keys: list[str] | None = None
                     ) -> DataFrame:
    """Per candidate: how many others of its run overlap it at or above ``threshold`` (> 0),
    and the strongest such overlap (NULL when there is none).

    Equal intervals are counted once with their number of copies, and only cells that could
    hold a partner are visited, so copies cost nothing and no list of pairs is ever written.
    """
    keys = keys or ["run_id"]
    cells = _Cells(threshold)
    spans = candidates.groupBy(*keys, "start", "end").agg(F.count("*").alias("copies"))
    there = spans.select(
        *keys, F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.col("copies").alias("o_copies"), *cells.cell())
    ratio = overlap_ratio(F.col("start"), F.col("end"), F.col("o_start"), F.col("o_end"))
    same = (F.col("start") == F.col("o_start")) & (F.col("end") == F.col("o_end"))
    others = F.when(same, F.col("o_copies") - 1).otherwise(F.col("o_copies"))
    found = (
        cells.spread(spans)
        .withColumnsRenamed({"near_band": "band", "near_slot": "slot"})
        .join(there, [*keys, "band", "slot"])
        .withColumns({"iou": ratio, "others": others})
        .where((F.col("iou") >= F.lit(threshold)) & (F.col("others") > 0))
        .groupBy(*keys, "start", "end")
        .agg(F.sum("others").alias("partners"), F.max("iou").alias("best_iou"))
    )
    return candidates.join(found, [*keys, "start", "end"], "left").select(
        *keys, "candidate_id",
        F.coalesce("partners", F.lit(0).cast("bigint")).alias("partners"), "best_iou")
