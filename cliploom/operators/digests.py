"""Digests: one string form per record, SHA-256, and trees of digests for long runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cliploom import rules
from cliploom.functions.columns import digest, unix_newlines

FANOUT = 1024
LEVELS = 3


def tree_digest(df: DataFrame, keys: Sequence[str], position: str, leaf: str, out: str
                ) -> DataFrame:
    """Digest of the ordered leaves of each key.

    Digests are joined 1024 at a time over a fixed number of levels, so no task ever gathers
    a whole run and the value does not depend on how the rows were partitioned. Leaves may be
    digests in hex, or the same in bytes, which are half as long.
    """
    level = df.select(*keys, F.col(position).alias("_at"), F.col(leaf).alias("_d"))
    for _ in range(LEVELS - 1):
        level = _join_digests(
            level.withColumn("_up", F.floor(F.col("_at") / FANOUT)), [*keys, "_up"]
        ).withColumnRenamed("_up", "_at").withColumn("_d", F.unhex("_d"))
    return _join_digests(level, list(keys)).withColumnRenamed("_d", out)


def _join_digests(level: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_d")))
    binary = level.schema["_d"].dataType == BinaryType()
    return level.groupBy(*keys).agg(
        F.sha2(F.array_join(F.transform(
            ordered, lambda r: F.lower(F.hex(r["_d"])) if binary else r["_d"]), "|"), 256).alias("_d")
    )


def segment_digest() -> Column:
    return digest(F.col("index"), F.col("start_ms"), F.col("end_ms"), F.col("text"))


def transcript_digest(segments_ms: DataFrame) -> DataFrame:
    """(run_id, transcript_sha256) over segments (index, start_ms, end_ms, text)."""
    leaves = segments_ms.withColumn("_leaf", F.unhex(segment_digest()))
    return tree_digest(leaves, ["run_id"], "index", "_leaf", "transcript_sha256")


def prompt_digest(text: str = rules.PROMPT_TEXT) -> Column:
    """Digest of a prompt text, whatever its line ends."""
    return F.sha2(unix_newlines(F.lit(text)), 256)


def candidate_identifier(prompt_version: str = rules.PROMPT_VERSION,
                         prompt_text: str = rules.PROMPT_TEXT) -> Column:
    """Identity of a proposal, taken before its boundary is touched. Another prompt text is
    another identity, whatever its label says."""
    return F.concat(F.lit("cand_"), F.substring(digest(
        F.lit(rules.CANDIDATE_ID_VERSION), F.col("transcript_sha256"), F.col("chunk_id"),
        F.col("ordinal"), F.lit(prompt_version), prompt_digest(prompt_text), F.col("p_start_ms"),
        F.col("p_end_ms"), F.col("category"), F.col("topic"), F.col("hook"), F.col("summary"),
        F.col("reason"), *[F.col(f"scores.{n}") for n in rules.SCORE_NAMES],
    ), 1, 16))


#: Settings that say where and how, not what; they do not identify a run.
ENVIRONMENT_ONLY = ("workspace.root",)


def config_digest(settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digest of (name, value) settings without the environment-only ones.

    A configuration is a few dozen settings, so one group is one small row.
    """
    entry = F.concat_ws("=", "name", F.coalesce("value", F.lit("~")))
    return settings.where(~F.col("name").isin(*ENVIRONMENT_ONLY)).groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_set(entry)), "|"), 256).alias("config_sha256"))


def stage_fingerprints(inputs: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """(run_id, stage, fingerprint, inputs_sha256): per stage, the digest of all that it was made
    from, and that of the inputs it reads itself.

    ``inputs`` has one row per run with a digest column per input. ``stages`` lists a stage's
    inputs: names of those columns, or of stages before it, so that a change anywhere upstream
    reaches every fingerprint downstream.
    """
    row = inputs
    for stage, names in stages.items():
        label = F.lit(f"{stage}-v1")
        parts = [F.col(f"s_{n}" if n in stages else n) for n in names]
        row = row.withColumns({
            f"s_{stage}": digest(label, *parts),
            f"i_{stage}": digest(label, *[F.col(n) for n in names if n not in stages])})
    entries = F.array(*[F.struct(
        F.lit(stage).alias("stage"), F.col(f"s_{stage}").alias("fingerprint"),
        F.col(f"i_{stage}").alias("inputs_sha256")) for stage in stages])
    return row.select("run_id", F.inline(entries))


def per_run(runs: DataFrame, digests: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per run with a column per (frame, column); each frame has one row per run."""
    row = runs.select("run_id")
    for name, (frame, column) in digests.items():
        row = row.join(frame.select("run_id", F.col(column).alias(name)), "run_id", "left")
    return row
