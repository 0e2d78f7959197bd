"""Ordered scans that do not send one run through one task.

A running value over a run is computed in two levels: inside fixed-size blocks of
positions, and over one summary row per block. The summaries are pre-aggregated before they
are shuffled, so a run holding a third of all rows is spread over as many tasks as it has
blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


_FOLD = {"max": F.max, "sum": F.sum}


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: dict[str, tuple[str, Column]],
    block: Column | None = None,
    summary_from: DataFrame | None = None,
) -> DataFrame:
    """Add, per row, what the rows before it in its run come to; NULL where none precedes.

    ``values`` maps an output name to (kind, column); kind is "max", "sum" or "last" (the
    value of the row just before). ``summary_from`` is a cheaper frame with the same keys,
    positions and values, read for the block summaries.
    """
    block = block if block is not None else F.floor(F.col(position) / BLOCK_ROWS)
    work = df.withColumn("_block", block)
    brief = (df if summary_from is None else summary_from).withColumn("_block", block)
    summaries, carries, insides, totals = [], [], {}, {}
    across = Window.partitionBy(*keys).orderBy("_block")
    inside = Window.partitionBy(*keys, "_block").orderBy(position)
    before = (Window.unboundedPreceding, -1)
    for name, (kind, column) in values.items():
        v, s, c, i = (F.col(f"_{p}_{name}") for p in "vsci")
        if kind == "last":
            work = work.withColumn(f"_v_{name}", F.struct(column.alias("x")))
            brief = brief.withColumn(f"_v_{name}", F.struct(column.alias("x")))
            summaries.append(F.max_by(v, F.col(position)).alias(f"_s_{name}"))
            carries.append(F.lag(s).over(across).alias(f"_c_{name}"))
            insides[f"_i_{name}"] = F.lag(v).over(inside)
            totals[name] = F.coalesce(i, c)["x"]
            continue
        fold = _FOLD[kind]
        work = work.withColumn(f"_v_{name}", column)
        brief = brief.withColumn(f"_v_{name}", column)
        summaries.append(fold(v).alias(f"_s_{name}"))
        carries.append(fold(s).over(across.rowsBetween(*before)).alias(f"_c_{name}"))
        insides[f"_i_{name}"] = fold(v).over(inside.rowsBetween(*before))
        both = F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0))
        totals[name] = F.greatest(i, c) if kind == "max" else F.when(
            i.isNotNull() | c.isNotNull(), both
        )
    carried = brief.groupBy(*keys, "_block").agg(*summaries).select(*keys, "_block", *carries)
    joined = work.withColumns(insides).join(carried, [*keys, "_block"]).withColumns(totals)
    return joined.drop("_block", *[f"_{p}_{n}" for n in values for p in "vsci"])


def dense_number(df: DataFrame, keys: Sequence[str], position: str, name: str) -> DataFrame:
    """0-based dense numbering of the rows of a run in position order."""
    counted = running_before(df, keys, position, {name: ("sum", F.lit(1).cast("bigint"))})
    return counted.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("bigint")))
