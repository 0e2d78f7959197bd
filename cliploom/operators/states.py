"""Run states and stage records over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import first_problem
from cliploom.operators.scans import running_before

def illegal_moves(history: DataFrame) -> DataFrame:
    """Rows of a status history (run_id, ts, event_id, status) no rule allows.

    Scanned hour by hour, so a run with a very long history is not one task.
    """
    placed = history.withColumn("_at", F.struct("ts", "event_id"))
    scanned = running_before(
        placed, ["run_id"], "_at", {"before": ("last", F.col("status"))},
        block=F.date_trunc("hour", "ts"))
    allowed = [f"{start}>{end}" for start, ends in rules.STATUS_MOVES.items() for end in ends]
    move = F.concat_ws(">", "before", "status")
    return scanned.where(
        F.col("before").isNotNull() & (F.col("before") != F.col("status"))
        & ~move.isin(*allowed)
    ).select("run_id", "event_id", F.col("before").alias("from_status"),
             F.col("status").alias("to_status"))


def stage_position(stage: str = "stage"):
    return F.array_position(F.array(*[F.lit(s) for s in rules.STAGES]), F.col(stage))


def stale_stages(records: DataFrame) -> DataFrame:
    """Stages completed before something upstream was completed again (at most 7 rows a run)."""
    upstream = Window.partitionBy("run_id").orderBy("stage_no").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        records.withColumn("stage_no", stage_position())
        .withColumn("upstream_at", F.max("completed_at").over(upstream))
        .where(F.col("upstream_at") > F.col("completed_at"))
        .select("run_id", "stage")
    )


def config_drift(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Runs created under another configuration than the current one."""
    return runs.join(current.withColumnRenamed("config_sha256", "current_sha256"), "run_id").where(
        ~F.col("config_sha256").eqNullSafe(F.col("current_sha256"))
    ).select("run_id", "config_sha256", "current_sha256")


def reuse_verdicts(wanted: DataFrame, recorded: DataFrame, schema_version: int = 1) -> DataFrame:
    """Whether a finished stage can be used again; the first failing check wins.

    ``wanted`` holds what can be rebuilt now: run_id, stage, fingerprint, config_sha256 of the
    stored configuration, wanted_config_sha256 of the settings asked for, inputs_sha256, and
    ``incoherent``. ``recorded`` holds what the run wrote down.
    """
    keys, c = ["run_id", "stage"], F.col
    noted = recorded.select(*keys, *[
        F.col(n).alias(f"r_{n}")
        for n in ("schema_version", "config_sha256", "inputs_sha256", "fingerprint")])
    return wanted.join(noted, keys, "left").select(*keys, F.coalesce(first_problem([
        ("missing", c("r_fingerprint").isNull()),
        ("schema_differs", c("r_schema_version") != schema_version),
        ("config_changed", c("r_config_sha256") != c("config_sha256")),
        ("incoherent", c("incoherent")),
        ("inputs_differ", c("r_inputs_sha256") != c("inputs_sha256")),
        ("fingerprint_differs", c("r_fingerprint") != c("fingerprint")),
        ("settings_differ", c("config_sha256") != c("wanted_config_sha256")),
    ]), F.lit("reusable")).alias("verdict"))
