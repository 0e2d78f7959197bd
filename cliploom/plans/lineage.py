"""Queries over digests, stage records and run states."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import digest, unix_newlines
from cliploom.operators import digests as D
from cliploom.operators import states as S
from cliploom.operators.replies import MAX_PROPOSALS
from cliploom.plans.audits import clip_index
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views
from cliploom.session import shared_folder, write_stage
from cliploom.sources.store import StageStore

_SCORES = ", ".join("sc_" + n for n in rules.SCORE_NAMES)


@plan("canonical_digest", f"""
SELECT run_id, candidate_id, sha256(concat_ws('|', ps, pe, category, topic, hook, summary, reason,
  {_SCORES})) AS digest FROM q_proposals""")
def canonical_digest(v: Views) -> DataFrame:
    return v.proposals.select("run_id", "candidate_id", _content().alias("digest"))


def _content():
    return digest(
        F.col("p_start_ms"), F.col("p_end_ms"),
        *[F.col(n) for n in ("category", "topic", "hook", "summary", "reason")],
        *[F.col(f"scores.{n}") for n in rules.SCORE_NAMES])


@plan("candidate_id", "SELECT run_id, chunk_id, ordinal, candidate_id FROM q_proposals")
def candidate_id(v: Views) -> DataFrame:
    rows = v.proposals.drop("candidate_id").join(v.transcript_digests, "run_id")
    return rows.select(
        "run_id", "chunk_id", "ordinal", D.candidate_identifier().alias("candidate_id"))


@plan("transcript_digest", "SELECT run_id, tsha AS transcript_sha256 FROM q_transcript")
def transcript_digest(v: Views) -> DataFrame:
    return D.transcript_digest(v.segments_ms)


@plan("prompt_digest", r"""
SELECT conv_id, turn, sha256(regexp_replace(text || chr(13) || chr(10) || role, '\r\n?', chr(10), 'g'))
  AS prompt_sha256 FROM conversations""")
def prompt_digest(v: Views) -> DataFrame:
    """Digest of a prompt text does not depend on its line endings."""
    text = F.concat("text", F.lit("\r\n"), "role")
    return v.table("conversations").select(
        "conv_id", "turn", F.sha2(unix_newlines(text), 256).alias("prompt_sha256"))


part("q_settings", """
SELECT run_id, unnest(['analysis.min_score', 'analysis.window', 'analysis.model',
    'workspace.root']) AS name,
  unnest([(60 + run_id % 3)::VARCHAR, '360', CASE WHEN run_id % 5 = 0 THEN NULL ELSE 'm1' END,
    '/data/' || run_id]) AS value FROM q_runs""")
part("q_config", """
SELECT run_id, sha256(string_agg(name || '=' || coalesce(value, '~'), '|' ORDER BY
  name || '=' || coalesce(value, '~'))) AS config_sha256
FROM q_settings WHERE name <> 'workspace.root'
GROUP BY run_id""")


def settings(v: Views) -> DataFrame:
    """(run, name, value) configuration rows."""
    r = F.col("run_id")
    pairs = [
        ("analysis.min_score", (60 + r % 3).cast("string")), ("analysis.window", F.lit("360")),
        ("analysis.model", F.when(r % 5 != 0, F.lit("m1"))),
        ("workspace.root", F.concat(F.lit("/data/"), r.cast("string"))),
    ]
    entries = F.array(*[
        F.struct(F.lit(n).alias("name"), value.cast("string").alias("value"))
        for n, value in pairs])
    return v.runs.select("run_id", F.explode(entries).alias("s")).select("run_id", "s.*")


@plan("config_digest", "SELECT run_id, config_sha256 FROM q_config")
def config_digest(v: Views) -> DataFrame:
    return D.config_digest(settings(v), ["run_id"])


@plan("config_drift", """
SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'old' ELSE config_sha256 END AS config_sha256,
  config_sha256 AS current_sha256 FROM q_config WHERE run_id % 9 = 0""")
def config_drift(v: Views) -> DataFrame:
    now = D.config_digest(settings(v), ["run_id"])
    made = now.withColumn("config_sha256", F.when(
        F.col("run_id") % 9 == 0, F.lit("old")).otherwise(F.col("config_sha256")))
    return S.config_drift(made, now)


part("q_leaf_chunks", """
SELECT run_id, chunk_index AS pos, sha256(concat_ws('|', chunk_id, round(s * 1000)::BIGINT,
  round(e * 1000)::BIGINT)) AS d FROM q_chunks""")
part("q_leaf_raw", f"""
SELECT run_id, chunk_index * 200 + ordinal AS pos, sha256(concat_ws('|', ps, pe, category, topic, hook,
  summary, reason, {_SCORES})) AS d FROM q_proposals""")
part("q_leaf_outcomes", """
SELECT run_id, chunk_index * 200 + ordinal AS pos, sha256(concat_ws('|', candidate_id, outcome,
  coalesce(rank::VARCHAR, '~'), round(fs * 1000)::BIGINT, round(fe * 1000)::BIGINT)) AS d
FROM q_outcomes""")
part("q_leaf_decisions", """
SELECT run_id, rank AS pos, sha256(concat_ws('|', candidate_id, decision,
  coalesce(round(ns * 1000)::BIGINT::VARCHAR, '~'), coalesce(round(ne * 1000)::BIGINT::VARCHAR, '~'),
  coalesce(reason, '~'), coalesce(detail, '~'))) AS d FROM q_decisions""")
part("q_leaf_clips", """
SELECT run_id, rank AS pos, sha256(concat_ws('|', candidate_id, round(s * 1000)::BIGINT,
  round(e * 1000)::BIGINT)) AS d FROM q_targets""")


def _tree_parts(name: str) -> None:
    part(f"q_t1_{name}", f"""
SELECT run_id, pos // 1024 AS b, sha256(string_agg(d, '|' ORDER BY pos)) AS d
FROM q_leaf_{name} GROUP BY run_id, pos // 1024""")
    part(f"q_t2_{name}", f"""
SELECT run_id, b // 1024 AS b, sha256(string_agg(d, '|' ORDER BY b)) AS d
FROM q_t1_{name} GROUP BY run_id, b // 1024""")
    part(f"q_t3_{name}", f"""
SELECT run_id, sha256(string_agg(d, '|' ORDER BY b)) AS d FROM q_t2_{name} GROUP BY run_id""")


part("q_leaf_files", "SELECT run_id, rank AS pos, sha AS d FROM q_index_full")
for _name in ("chunks", "raw", "outcomes", "decisions", "clips", "files"):
    _tree_parts(_name)

#: Per stage, the digests and the stages before it that it is made from.
STAGE_INPUTS = {
    "transcription": ["audio", "text", "config"],
    "analysis": ["transcription", "chunks", "raw", "outcomes", "config"],
    "preview": ["analysis", "outcomes", "config"],
    "review": ["analysis", "preview", "decisions", "config"],
    "render": ["review", "clips", "files", "config"],
}
_INPUTS = ("audio", "text", "chunks", "raw", "outcomes", "decisions", "clips", "files", "config")
#: What had another value when the stages were recorded: input, and runs by remainder.
CHANGED = {"text": (11, 3), "audio": (13, 4), "decisions": (7, 2), "files": (17, 5), "config": (19, 6)}

part("q_inputs", """
SELECT r.run_id, sha256(coalesce(documents.text, '')) AS audio, tsha AS text, c.d AS chunks,
  p.d AS raw, o.d AS outcomes, x.d AS decisions, k.d AS clips, f.d AS files, config_sha256 AS config
FROM q_runs r JOIN documents ON doc_id = r.run_id
  JOIN q_transcript t ON t.run_id = r.run_id JOIN q_config g ON g.run_id = r.run_id
  LEFT JOIN q_t3_chunks c ON c.run_id = r.run_id LEFT JOIN q_t3_raw p ON p.run_id = r.run_id
  LEFT JOIN q_t3_outcomes o ON o.run_id = r.run_id LEFT JOIN q_t3_decisions x ON x.run_id = r.run_id
  LEFT JOIN q_t3_clips k ON k.run_id = r.run_id LEFT JOIN q_t3_files f ON f.run_id = r.run_id""")
part("q_inputs_then", "SELECT run_id, " + ", ".join(
    f"CASE WHEN run_id % {CHANGED[n][0]} = {CHANGED[n][1]} THEN sha256('then|' || coalesce({n}, '~')) "
    f"ELSE {n} END AS {n}" if n in CHANGED else n for n in _INPUTS) + " FROM q_inputs")


def _chain(source: str) -> str:
    """SQL of the fingerprints that follow from a table of inputs."""
    def joined(stage: str, names: list[str]) -> str:
        return f"sha256(concat_ws('|', '{stage}-v1', " + ", ".join(
            f"s_{n}" if n in STAGE_INPUTS else f"coalesce({n}, '~')" for n in names) + "))"

    sql = f"SELECT * FROM {source}"
    for stage, names in STAGE_INPUTS.items():
        own = joined(stage, [n for n in names if n not in STAGE_INPUTS])
        sql = f"SELECT *, {joined(stage, names)} AS s_{stage}, {own} AS i_{stage} FROM ({sql})"
    columns = [", ".join(f"{kind}_{stage}" for stage in STAGE_INPUTS) for kind in "si"]
    return (f"SELECT run_id, config, unnest({list(STAGE_INPUTS)}) AS stage, "
            f"unnest([{columns[0]}]) AS fingerprint, unnest([{columns[1]}]) AS inputs FROM ({sql})")


part("q_fingerprints", _chain("q_inputs"))
part("q_fingerprints_then", _chain("q_inputs_then"))


def stage_inputs(v: Views) -> DataFrame:
    """One row per run with the digest of everything a stage may be made from."""
    c = F.col

    def whole(x: str):
        return F.round(c(x) * 1000).cast("bigint")

    def tree(df: DataFrame, at, *parts) -> DataFrame:
        return leaves(df.select("run_id", at.alias("at"), F.unhex(digest(*parts)).alias("leaf")))

    def leaves(df: DataFrame) -> DataFrame:
        return D.tree_digest(df, ["run_id"], "at", "leaf", "d")

    # a reply holds MAX_PROPOSALS at most, so chunks keep apart and the order is that of reading
    chunk = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("bigint")
    place = chunk * MAX_PROPOSALS + c("ordinal")
    heard = v.table("documents").select(
        c("doc_id").alias("run_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("d"))
    return D.per_run(v.runs, {
        "audio": (heard, "d"),
        "text": (v.transcript_digests, "transcript_sha256"),
        "chunks": (tree(v.chunks, c("chunk_index"), c("chunk_id"), whole("start"), whole("end")), "d"),
        "raw": (leaves(v.proposals.select(
            "run_id", place.alias("at"), F.unhex(_content()).alias("leaf"))), "d"),
        "outcomes": (tree(v.outcomes, place, c("candidate_id"), c("outcome"), c("rank"),
                          whole("start"), whole("end")), "d"),
        "decisions": (tree(v.decisions, c("rank"), c("candidate_id"), c("decision"),
                           whole("final_start"), whole("final_end"), c("reason"), c("detail")), "d"),
        "clips": (tree(v.targets, c("rank"), c("candidate_id"), whole("start"), whole("end")), "d"),
        "files": (leaves(clip_index(v).select(
            "run_id", c("rank").alias("at"), c("sha256").alias("leaf"))), "d"),
        "config": (D.config_digest(settings(v), ["run_id"]), "config_sha256"),
    })


def inputs_then(inputs: DataFrame) -> DataFrame:
    """The inputs as they were when the stages were recorded."""
    def old(name: str):
        return F.sha2(F.concat(F.lit("then|"), F.coalesce(name, F.lit("~"))), 256)

    return inputs.withColumns({
        name: F.when(F.col("run_id") % n == rest, old(name)).otherwise(F.col(name))
        for name, (n, rest) in CHANGED.items()})


@plan("stage_fingerprints", "SELECT run_id, stage, fingerprint FROM q_fingerprints")
def stage_fingerprints(v: Views) -> DataFrame:
    return D.stage_fingerprints(stage_inputs(v), STAGE_INPUTS).drop("inputs_sha256")


_STAGE_NO = "list_position(['inspect', 'audio', 'transcription', 'analysis', 'preview', 'review', 'render'], stage)"


@plan("reuse_audit", f"""
SELECT n.run_id, n.stage, CASE WHEN f = 0 THEN 'missing' WHEN f = 1 THEN 'schema_differs'
  WHEN t.config <> n.config THEN 'config_changed' WHEN f = 3 THEN 'incoherent'
  WHEN t.inputs <> n.inputs THEN 'inputs_differ'
  WHEN t.fingerprint <> n.fingerprint THEN 'fingerprint_differs'
  WHEN f = 6 THEN 'settings_differ' ELSE 'reusable' END AS verdict
FROM (SELECT *, (run_id * 5 + {_STAGE_NO}) % 13 AS f FROM q_fingerprints) n
JOIN q_fingerprints_then t USING (run_id, stage)""")
def reuse_audit(v: Views) -> DataFrame:
    """What is wanted now beside what the runs wrote down when some inputs were others: a stage is
    reusable only if nothing that it was made from, at any distance, has changed since."""
    c = F.col
    f = (c("run_id") * 5 + S.stage_position()) % 13
    now = write_stage(stage_inputs(v), "inputs", compression="zstd")
    then = inputs_then(now)

    def made(inputs: DataFrame) -> DataFrame:
        return D.stage_fingerprints(inputs, STAGE_INPUTS).join(
            inputs.select("run_id", c("config").alias("config_sha256")), "run_id").withColumn("f", f)

    wanted = made(now).select(
        "run_id", "stage", "fingerprint", "config_sha256", "inputs_sha256",
        F.when(c("f") == 6, F.lit("new")).otherwise(c("config_sha256"))
        .alias("wanted_config_sha256"), (c("f") == 3).alias("incoherent"))
    recorded = made(then).where("f <> 0").select(
        "run_id", "stage", F.when(c("f") == 1, 2).otherwise(1).alias("schema_version"),
        "config_sha256", "inputs_sha256", "fingerprint")
    return S.reuse_verdicts(wanted, recorded)


part("q_todo", """
SELECT n.run_id, n.stage FROM q_fingerprints n
JOIN q_fingerprints_then t USING (run_id, stage) WHERE n.fingerprint <> t.fingerprint""")


@plan("stages_to_do", """
SELECT stage, count(*) AS runs, sum(run_id)::BIGINT AS run_ids FROM q_todo GROUP BY stage""")
def stages_to_do(v: Views) -> DataFrame:
    """Stages are stored as they were then; what a store still has to compute now is exactly what
    is made from something that has changed."""
    now = write_stage(stage_inputs(v), "inputs", compression="zstd")
    store = StageStore(v.spark, f"{shared_folder(v.spark)}/store-{uuid.uuid4().hex}")
    before = D.stage_fingerprints(inputs_then(now), STAGE_INPUTS)
    wanted = D.stage_fingerprints(now, STAGE_INPUTS)
    todo = []
    for stage in STAGE_INPUTS:
        own = before.where(F.col("stage") == stage)
        store.ensure(stage, own, lambda runs: runs.select("run_id"))
        todo.append(store.missing(stage, wanted.where(F.col("stage") == stage)).select(
            "run_id", F.lit(stage).alias("stage")))
    return functools.reduce(DataFrame.unionAll, todo).groupBy("stage").agg(
        F.count("*").alias("runs"), F.sum("run_id").alias("run_ids"))


part("q_records", """
SELECT run_id, stage, (1700000000 + run_id * 100 + list_position(['inspect', 'audio',
  'transcription', 'analysis', 'preview', 'review', 'render'], stage)
  + CASE WHEN (run_id * 3 + list_position(['inspect', 'audio', 'transcription', 'analysis',
  'preview', 'review', 'render'], stage)) % 17 = 0 THEN 10 ELSE 0 END)::BIGINT AS completed_at
FROM (SELECT run_id, unnest(['inspect', 'audio', 'transcription', 'analysis', 'preview', 'review',
  'render']) AS stage FROM q_runs)""")


def stage_records(v: Views) -> DataFrame:
    """Completion times of all stages; some stages were run again later."""
    rows = v.runs.select(
        "run_id", F.explode(F.array(*[F.lit(s) for s in rules.STAGES])).alias("stage"))
    no = S.stage_position()
    again = F.when((F.col("run_id") * 3 + no) % 17 == 0, F.lit(10)).otherwise(F.lit(0))
    return rows.withColumn(
        "completed_at", (F.lit(1700000000) + F.col("run_id") * 100 + no + again).cast("bigint"))


@plan("stale_downstream", f"""
SELECT DISTINCT d.run_id, d.stage FROM q_records d JOIN q_records u
  ON u.run_id = d.run_id AND {_STAGE_NO.replace('stage)', 'u.stage)')} <
     {_STAGE_NO.replace('stage)', 'd.stage)')}
  AND u.completed_at > d.completed_at""")
def stale_downstream(v: Views) -> DataFrame:
    return S.stale_stages(stage_records(v))


_STATUSES = "[" + ", ".join(f"'{s}'" for s in rules.RUN_STATUSES) + "]"
_MOVES_SQL = """
SELECT a || '>' || b AS move FROM (VALUES
 ('CREATED','INSPECTED'), ('INSPECTED','AUDIO_READY'), ('AUDIO_READY','TRANSCRIBED'),
 ('TRANSCRIBED','ANALYZED'), ('ANALYZED','READY_FOR_REVIEW'), ('READY_FOR_REVIEW','REVIEWED'),
 ('REVIEWED','RENDERED'), ('RENDERED','COMPLETED'), ('REVIEWED','READY_FOR_REVIEW')) m(a, b)
UNION ALL
SELECT unnest([before || '>' || failed, done || '>' || failed, failed || '>' || done])
FROM (VALUES ('CREATED','INSPECTED','FAILED_INSPECT'), ('INSPECTED','AUDIO_READY','FAILED_AUDIO'),
 ('AUDIO_READY','TRANSCRIBED','FAILED_TRANSCRIPTION'), ('TRANSCRIBED','ANALYZED','FAILED_ANALYSIS'),
 ('ANALYZED','READY_FOR_REVIEW','FAILED_PREVIEW'), ('READY_FOR_REVIEW','REVIEWED','FAILED_REVIEW'),
 ('REVIEWED','RENDERED','FAILED_RENDER')) s(before, done, failed)"""


@plan("transition_audit", f"""
SELECT run_id, event_id, from_status, to_status FROM (
  SELECT user_id AS run_id, event_id, {_STATUSES}[(event_id % 16) + 1] AS to_status,
    lag({_STATUSES}[(event_id % 16) + 1]) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      AS from_status FROM events)
WHERE from_status IS NOT NULL AND from_status <> to_status
  AND from_status || '>' || to_status NOT IN ({_MOVES_SQL})""")
def transition_audit(v: Views) -> DataFrame:
    status = F.element_at(
        F.array(*[F.lit(s) for s in rules.RUN_STATUSES]), (F.col("event_id") % 16 + 1).cast("int"))
    history = v.table("events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", status.alias("status"))
    return S.illegal_moves(history)
