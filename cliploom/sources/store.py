"""Stage tables kept by what they were made from.

A stage's rows are stored per run under the fingerprint of its inputs. What is to do is an
anti-join of the wanted (run, fingerprint) with the recorded ones; only that is computed, so a
second session with the same inputs computes nothing, and a changed input leaves the old rows
where they are. Rows are written first and recorded last: what a killed job leaves is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.session import files_of

KEYS = ["run_id", "fingerprint"]


class StageStore:
    """Stages under one folder that all executors share: <stage>/rows and <stage>/done."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def records(self, stage: str) -> DataFrame | None:
        """(run_id, fingerprint, batch) of finished rows, one each, or None before the first."""
        done = self._read(f"{self.root}/{stage}/done")
        # two sessions may have made the same rows; one batch of them counts
        return done and done.groupBy(*KEYS).agg(F.min("batch").alias("batch"))

    def missing(self, stage: str, wanted: DataFrame) -> DataFrame:
        """The wanted (run_id, fingerprint) without rows."""
        done = self.records(stage)
        keys = wanted.select(*KEYS).distinct()
        return keys if done is None else keys.join(done, KEYS, "left_anti")

    def ensure(self, stage: str, wanted: DataFrame,
               compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stage's rows for all wanted (run_id, fingerprint), computed where they are missing.

        ``compute`` takes the runs to do (run_id, fingerprint) and returns rows with run_id. A run
        without rows is recorded as well, so it is not computed again."""
        todo = self.missing(stage, wanted)
        if not todo.isEmpty():
            batch = uuid.uuid4().hex
            plan = f"{self.root}/{stage}/todo/batch={batch}"
            todo.write.parquet(plan)  # what is to do does not change while it is done
            todo = self.spark.read.parquet(plan)
            rows = compute(todo).join(todo.select(*KEYS), "run_id")
            rows.write.parquet(f"{self.root}/{stage}/rows/batch={batch}")
            todo.select(*KEYS).write.parquet(f"{self.root}/{stage}/done/batch={batch}")
        rows, done = self._read(f"{self.root}/{stage}/rows"), self.records(stage)
        if rows is None or done is None:
            return compute(todo).join(todo, "run_id").where("false")
        current = done.join(wanted.select(*KEYS).distinct(), KEYS, "left_semi")
        return rows.join(current, [*KEYS, "batch"], "left_semi").drop("batch")

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", path).schema(
                self.spark.read.parquet(path).schema).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame],
            problems: dict[str, DataFrame] | None = None) -> str:
    """Publish several tables as one version, or nothing.

    ``problems`` are frames that must be empty; they are looked at before anything is written.
    Tables are written to a place of their own, and one mark is written last. Readers follow the
    newest mark only, so a job that dies in between leaves the version before in force."""
    for name, frame in (problems or {}).items():
        if not frame.isEmpty():
            raise ValueError(f"not published: {name} has rows")
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/versions/{version}/{name}")
    mark = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at"),
        F.array(*[F.lit(name) for name in sorted(tables)]).alias("tables"))
    mark.coalesce(1).write.parquet(f"{root}/marks/{version}")
    return version


def published(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version; none before the first is complete."""
    marks = [f for f in files_of(spark, f"{root}/marks") if f.path.endswith("/_SUCCESS")]
    if not marks:
        return {}
    found = spark.read.parquet(*[f.path.removesuffix("/_SUCCESS") for f in marks])
    last = found.orderBy(F.desc("published_at"), F.desc("version")).first()
    return {name: spark.read.parquet(f"{root}/versions/{last.version}/{name}")
            for name in last.tables}
