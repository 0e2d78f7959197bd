"""Streaming queries over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.plans.registry import plan
from cliploom.plans.views import Views, decision_log
from cliploom.streaming import reviews as S


def _event_stream(v: Views) -> DataFrame:
    schema = v.table("events").schema
    return v.spark.readStream.schema(schema).parquet(f"{v.folder}/events*.parquet")


def _utc(column: str) -> Column:
    """A wall-clock column read as UTC, whatever zone the session uses."""
    return F.timestamp_micros(F.expr(
        f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"))


@plan("stream_latest_decision", """
SELECT run_id, candidate_id, decision, event_id FROM q_decision_log
QUALIFY row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY ts DESC, event_id DESC) = 1
""")
def stream_latest_decision(v: Views) -> DataFrame:
    return S.latest_decisions(decision_log(_event_stream(v)))


@plan("stream_usage", """
SELECT user_id AS run_id, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*) AS calls,
  sum(round(value * 100)::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL""")
def stream_usage(v: Views) -> DataFrame:
    usage = _event_stream(v).select(
        F.col("user_id").alias("run_id"), _utc("ts").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    return S.usage_windows(usage).withColumn(
        "window_start", F.unix_seconds("window_start"))


@plan("stream_usage_late", """
SELECT user_id AS run_id, epoch(date_trunc('day', ts))::BIGINT AS window_start, count(*) AS calls,
  sum(round(value * 100)::BIGINT)::BIGINT AS tokens, 0::BIGINT AS late_calls FROM events GROUP BY ALL""")
def stream_usage_late(v: Views) -> DataFrame:
    """Usage with the calls that came too late for their window, from one pass over the stream. The
    given events are one batch, so none is late; tests take several."""
    usage = _event_stream(v).select(
        F.col("user_id").alias("run_id"), _utc("ts").alias("ts"),
        F.round(F.col("value") * 100).cast("bigint").alias("tokens"))
    counted, late = S.usage_with_late(usage)
    keys = ["run_id", "window_start"]
    joined = counted.join(late.select(*keys, F.col("calls").alias("late_calls")), keys, "full_outer")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "run_id", F.unix_seconds("window_start").alias("window_start"),
        *[F.coalesce(c, zero).alias(c) for c in ("calls", "tokens", "late_calls")])
