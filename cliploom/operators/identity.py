"""Whether the records of a stage describe the run that they lie beside.

Records of many kinds (what the run holds, the stage's index, its configuration) have one row per
run. Rules say which field of which record must equal which field of another, in a fixed order; the
first that does not hold is the run's problem. All rules of a stage are one plan: the records are
joined once, whatever their number, and a record that a run lacks is a problem of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.functions.columns import first_problem


@dataclass(frozen=True)
class Same:
    """``left`` and ``right`` are "record.field"; ``right`` may be a fixed value instead. Nulls are
    equal to nulls only."""

    name: str
    left: str
    right: str | int


#: Schema versions that a stage of this library reads.
CANDIDATES_SCHEMA, DECISIONS_SCHEMA = 1, 1
PREVIEW_RULES = (
    Same("analysis", "index.analysis_fingerprint", "run.analysis_fingerprint"),
    Same("source", "index.source_sha256", "run.source_sha256"),
    Same("width", "index.width", "config.width"),
    Same("height", "index.height", "config.height"),
    Same("rules_version", "index.rules_version", "config.rules_version"),
    Same("candidates_schema", "config.candidates_schema", CANDIDATES_SCHEMA),
)
RENDER_RULES = (
    Same("analysis", "index.analysis_fingerprint", "run.analysis_fingerprint"),
    Same("review", "index.review_fingerprint", "run.review_fingerprint"),
    Same("decision_file", "index.decisions_sha256", "run.decisions_sha256"),
    Same("transcript", "index.transcript_sha256", "run.transcript_sha256"),
    Same("source", "index.source_sha256", "run.source_sha256"),
    Same("width", "index.width", "config.width"),
    Same("height", "index.height", "config.height"),
    Same("preset", "index.preset", "config.preset"),
    Same("burned_subtitles", "index.burned", "config.burned"),
    Same("rules_version", "index.rules_version", "config.rules_version"),
    Same("candidates_schema", "config.candidates_schema", CANDIDATES_SCHEMA),
    Same("decisions_schema", "config.decisions_schema", DECISIONS_SCHEMA),
)


def coherence(records: dict[str, DataFrame], rules: Sequence[Same],
              entries: DataFrame | None = None) -> DataFrame:
    """(run_id, problem) of every run that any record names; problem is null for coherent ones.

    Order: ``missing_<record>`` in the order of ``records``, the rules, then what is wrong with the
    entries of a run: ``entries`` is a report (run_id, rank, problem) and its first row counts."""
    joined: DataFrame | None = None
    for kind, frame in records.items():
        held = frame.select("run_id", F.struct(*[c for c in frame.columns if c != "run_id"]).alias(kind))
        joined = held if joined is None else joined.join(held, "run_id", "full_outer")
    listed = None
    if entries is not None:
        first = entries.where("problem IS NOT NULL").groupBy("run_id").agg(
            F.min(F.struct("rank", "problem")).alias("_entry"))
        joined, listed = joined.join(first, "run_id", "left"), F.col("_entry.problem")

    def side(value: str | int) -> Column:
        return F.col(value) if isinstance(value, str) else F.lit(value)

    found = first_problem([
        *[(f"missing_{kind}", F.col(kind).isNull()) for kind in records],
        *[(rule.name, ~side(rule.left).eqNullSafe(side(rule.right))) for rule in rules]])
    return joined.select("run_id", (found if listed is None else F.coalesce(found, listed)).alias("problem"))
