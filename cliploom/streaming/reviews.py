"""Incremental forms of two batch operators over an event stream."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.session import files_of, remove, shared_folder, write_stage


#: Batches whose changes wait before they are merged into the table.
MERGED = 16


class ChangedTable:
    """A table that a stream keeps up to date: one row per key, that of the latest batch or, with
    ``summed``, the sums of all batches.

    A batch lands as a folder of changes. Every MERGED batches these are merged with the table
    into a new version, and what it replaces is removed, so the table stays as large as its keys
    however many batches there were. A batch that is retried overwrites its own folder; a version
    that is complete is not made again."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], values: list[str],
                 merged: int = MERGED, summed: bool = False) -> None:
        self.spark, self.folder, self.keys, self.values = spark, folder, keys, values
        self.merged, self.summed = merged, summed

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that Spark has finished."""
        ends = [f.path for f in files_of(self.spark, f"{self.folder}/{kind}")
                if f.path.endswith("/_SUCCESS")]
        return sorted(int(re.search(rf"/{kind}/batch=(\d+)/_SUCCESS$", path)[1]) for path in ends)

    def _current(self, upto: int | None = None) -> DataFrame | None:
        """The last row of every key in the newest version and the changes after it."""
        def before(kind: str) -> list[int]:
            return [n for n in self._complete(kind) if upto is None or n <= upto]

        versions = before("table")[-1:]
        later = [n for n in before("changes") if not versions or n > versions[0]]
        parts = [f"{self.folder}/table/batch={n}" for n in versions]
        parts += [f"{self.folder}/changes/batch={n}" for n in later]
        if not parts:
            return None
        rows = self.spark.read.parquet(*parts)
        if self.summed:
            return rows.groupBy(*self.keys).agg(
                F.max("batch").alias("batch"), *[F.sum(v).alias(v) for v in self.values])
        latest = F.max_by(F.struct("batch", *self.values), "batch").alias("v")
        return rows.groupBy(*self.keys).agg(latest).select(*self.keys, "v.*")

    def land(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(*self.keys, F.lit(number).cast("long").alias("batch"), *self.values)
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        if (number + 1) % self.merged or number in self._complete("table"):
            return
        self._current(number).write.mode("overwrite").parquet(f"{self.folder}/table/batch={number}")
        # readers may still hold the version before; what lies behind it is not read any more
        kept = self._complete("table")[-2:]
        remove(self.spark, *[f"{self.folder}/table/batch={n}" for n in self._complete("table") if n < kept[0]],
               *[f"{self.folder}/changes/batch={n}" for n in self._complete("changes") if n <= kept[0]
                 and len(kept) > 1])

    def read(self) -> DataFrame:
        return self._current().select(*self.keys, *self.values)


def _run_to_end(result: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Drive the stream over all available input and read the table it leaves."""
    spark = result.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = ChangedTable(spark, folder, keys, values)
    query = (
        result.writeStream.outputMode("update").foreachBatch(table.land)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.read()


def latest_decisions(log: DataFrame) -> DataFrame:
    """Decision stream -> the current decision per candidate.

    State is one row per candidate; each batch emits only what changed, and the table that the
    changes are merged into is as large as the candidates.
    """
    keys = ["run_id", "candidate_id"]
    last = F.struct("ts", "event_id")
    current = log.groupBy(*keys).agg(
        F.max_by("decision", last).alias("decision"), F.max(last)["event_id"].alias("event_id"))
    return _run_to_end(current, keys, ["decision", "event_id"])


def usage_windows(usage: DataFrame, width: str = "1 day", lateness: str = "2 hours"
                  ) -> DataFrame:
    """Usage stream -> calls and tokens per run and window; rows past the watermark are late."""
    counted = (
        usage.withWatermark("ts", lateness)
        .groupBy("run_id", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
        .select("run_id", F.col("w.start").alias("window_start"), "calls", "tokens")
    )
    return _run_to_end(counted, ["run_id", "window_start"], ["calls", "tokens"])


def usage_with_late(usage: DataFrame, width: str = "1 day", lateness: str = "2 hours"
                    ) -> tuple[DataFrame, DataFrame]:
    """Usage stream -> (counted, late), both (run_id, window_start, calls, tokens), from one pass.

    A row is late if its window had ended, by the watermark, before its batch began: the latest
    time of all earlier batches less ``lateness``, as Spark's own watermark has it. counted is what
    `usage_windows` counts; late is what it leaves out, by run and window. Both tables grow with
    their keys. The latest time of every batch is one small row, so a batch that is retried finds
    the watermark that it had before."""
    spark = usage.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    keys, values = ["run_id", "window_start"], ["calls", "tokens"]
    counted, late = (ChangedTable(spark, f"{folder}/{name}", keys, values, summed=True)
                     for name in ("counted", "late"))
    seen = ChangedTable(spark, f"{folder}/seen", ["one"], ["latest"])

    def land(batch: DataFrame, number: int) -> None:
        before = seen._current(number - 1)
        latest = before.first().latest if before is not None else None
        mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        placed = batch.withColumn("w", F.window("ts", width)).withColumn(
            "is_late", F.coalesce(F.col("w.end") <= mark, F.lit(False)))
        sums = placed.groupBy("run_id", F.col("w.start").alias("window_start"), "is_late").agg(
            F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
        rows = write_stage(sums, "usage")
        counted.land(rows.where("NOT is_late"), number)
        late.land(rows.where("is_late"), number)
        newest = batch.agg(F.max("ts").alias("latest")).first().latest
        newest = max((t for t in (latest, newest) if t is not None), default=None)
        seen.land(spark.createDataFrame([(1, newest)], "one int, latest timestamp"), number)

    query = (
        usage.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return counted.read(), late.read()
