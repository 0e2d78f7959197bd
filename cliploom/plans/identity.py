"""Queries over the records of previews and renders; a hash of the run damages one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.columns import digest
from cliploom.operators import identity as I
from cliploom.plans import audits
from cliploom.plans.registry import CHECKS, part, plan
from cliploom.plans.views import Views

#: What is damaged, by run_id % 29; every other run is whole.
_PREVIEW = ("missing_index", "missing_config", *[r.name for r in I.PREVIEW_RULES])
_RENDER = ("missing_index", "missing_config", *[r.name for r in I.RENDER_RULES])

part("q_preview_verdicts", CHECKS["preview_reconcile"])
part("q_render_verdicts", CHECKS["index_reconcile"])


def _check(names: tuple[str, ...], verdicts: str) -> str:
    return f"""
SELECT r.run_id, CASE WHEN r.run_id % 29 < {len(names)} THEN {list(names)}[1 + r.run_id % 29]
  ELSE coalesce(e.first, 'ok') END AS verdict
FROM q_runs r LEFT JOIN (SELECT run_id, arg_min(verdict, candidate_id) AS first FROM {verdicts}
  WHERE verdict <> 'ok' GROUP BY run_id) e USING (run_id)"""


def _held(v: Views) -> DataFrame:
    """What every run holds."""
    heard = v.table("documents").select(
        F.col("doc_id").alias("run_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))
    sha = F.col("transcript_sha256")
    return v.transcript_digests.join(heard, "run_id").select(
        "run_id", sha, "source_sha256", digest(F.lit("analysis"), sha).alias("analysis_fingerprint"),
        digest(F.lit("review"), sha).alias("review_fingerprint"),
        digest(F.lit("decisions"), F.col("run_id")).alias("decisions_sha256"))


def _coherence(v: Views, names: tuple[str, ...], rules: tuple[I.Same, ...], entries: DataFrame
               ) -> DataFrame:
    f = F.col("run_id") % 29
    held = _held(v)

    def hit(name: str, wrong: Column, right: Column) -> Column:
        return F.when(f == names.index(name), wrong).otherwise(right) if name in names else right

    prints = {"analysis": "analysis_fingerprint", "review": "review_fingerprint",
              "decision_file": "decisions_sha256", "transcript": "transcript_sha256",
              "source": "source_sha256"}
    index = held.where(f != names.index("missing_index")).select(
        "run_id", *[hit(name, F.lit("other"), F.col(c)).alias(c) for name, c in prints.items()],
        hit("width", F.lit(1), F.lit(1080)).alias("width"),
        hit("height", F.lit(1), F.lit(1920)).alias("height"),
        hit("preset", F.lit("fast"), F.lit("standard")).alias("preset"),
        hit("burned_subtitles", F.lit(False), F.lit(True)).alias("burned"),
        hit("rules_version", F.lit(9), F.lit(1)).alias("rules_version"))
    config = held.where(f != names.index("missing_config")).select(
        "run_id", F.lit(1080).alias("width"), F.lit(1920).alias("height"),
        F.lit("standard").alias("preset"), F.lit(True).alias("burned"),
        F.lit(1).alias("rules_version"),
        hit("candidates_schema", F.lit(9), F.lit(I.CANDIDATES_SCHEMA)).alias("candidates_schema"),
        hit("decisions_schema", F.lit(9), F.lit(I.DECISIONS_SCHEMA)).alias("decisions_schema"))
    listed = entries.select("run_id", F.col("candidate_id").alias("rank"),
                            F.nullif(F.col("verdict"), F.lit("ok")).alias("problem"))
    return I.coherence({"run": held, "index": index, "config": config}, rules, listed).select(
        "run_id", F.coalesce("problem", F.lit("ok")).alias("verdict"))


@plan("preview_identity", _check(_PREVIEW, "q_preview_verdicts"))
def preview_identity(v: Views) -> DataFrame:
    return _coherence(v, _PREVIEW, I.PREVIEW_RULES, audits.preview_reconcile(v))


@plan("render_identity", _check(_RENDER, "q_render_verdicts"))
def render_identity(v: Views) -> DataFrame:
    return _coherence(v, _RENDER, I.RENDER_RULES, audits.index_reconcile(v))
