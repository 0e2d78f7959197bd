"""Refusals of whole runs.

A run is accepted whole or refused whole, with the first thing wrong with it. Every operator that
can refuse reports (run_id, problem) rows; the ledger keeps one row per run, and every later step
reads only admitted runs. Nothing of a refused run gets through, wherever its other rows are.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(found: dict[str, DataFrame]) -> DataFrame:
    """(run_id, operator, problem, n_problems) of refused runs.

    ``found`` names the reports (run_id, problem) in the order in which operators run; the first
    operator's problem counts, and of one operator's the first by ``rank`` where the report has
    that column, else by name."""
    reports = [
        report.select("run_id", F.struct(
            F.lit(i).alias("step"), (F.col("rank") if "rank" in report.columns else F.lit(0)).alias("rank"),
            "problem", F.lit(name).alias("operator")).alias("entry"))
        for i, (name, report) in enumerate(found.items())]
    return (
        functools.reduce(DataFrame.unionAll, reports).groupBy("run_id")
        .agg(F.min("entry").alias("first"), F.count("*").alias("n_problems"))
        .select("run_id", "first.operator", "first.problem", "n_problems")
    )


def admitted(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """The rows of runs that are not in a ledger."""
    return rows.join(refused.select("run_id"), "run_id", "left_anti")


def ranked(report: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A report with the rank of each problem in a fixed order."""
    return report.withColumn("rank", F.array_position(F.array(*map(F.lit, order)), F.col("problem")).cast("int"))
