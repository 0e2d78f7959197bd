"""Queries over recorded JSON documents; some are damaged by a hash of their run."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import ms
from cliploom.operators import review as R
from cliploom.operators.selection import funnel
from cliploom.plans.lineage import settings, stage_records
from cliploom.plans.audits import clip_index
from cliploom.plans.registry import part, plan
from cliploom.plans.views import Views
from cliploom.session import shared_folder
from cliploom.sources import documents as S
from cliploom.sources import media as M
from cliploom.sources.store import publish, published

#: Verdict of each damage, by run_id % 11; all other documents are sound.
_DAMAGE = """CASE run_id % 11 WHEN 0 THEN 'schema_version' WHEN 1 THEN 'not_json'
  WHEN 2 THEN 'not_object' WHEN 3 THEN 'unknown_field' WHEN 4 THEN 'missing_field' ELSE 'ok' END"""
_SOUND = "run_id % 11 > 4"


def damaged(fields: list[Column], version: int) -> Column:
    """One document per run; ``fields`` come after schema_version and run_id."""
    run, f = F.col("run_id"), F.col("run_id") % 11
    whole = F.to_json(
        F.struct(F.lit(version).alias("schema_version"), run.alias("run_id"), *fields))
    other = F.to_json(
        F.struct(F.lit(version + 1).alias("schema_version"), run.alias("run_id"), *fields))
    missing = F.to_json(
        F.struct(F.lit(version).alias("schema_version"), run.alias("run_id"), *fields[:-1]))
    return (
        F.when(f == 0, other).when(f == 1, F.expr("substr('{\"schema_version\":1,', 1, 12)"))
        .when(f == 2, F.concat(F.lit("["), whole, F.lit("]")))
        .when(f == 3, F.concat(F.lit('{"note":"x",'), F.substring(whole, 2, 2147483647)))
        .when(f == 4, missing).otherwise(whole)
    )


def _verdicts(parsed: DataFrame, *more: Column) -> DataFrame:
    return parsed.select(
        "run_id", F.coalesce("problem", F.lit("ok")).alias("verdict"), *more)


def _ordered(rows: DataFrame, by: str, name: str, fields: list[Column]) -> DataFrame:
    """One array per run, for writing one document per run."""
    entry = F.struct(F.col(by).alias("_at"), F.struct(*fields).alias("x"))
    return rows.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias(name))


def transcript_documents(v: Views) -> DataFrame:
    c = F.col
    words = v.words.groupBy("run_id", "seg_index").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("word_pos", "word", "start", "end"))),
        lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"),
                           w["end"].alias("end"), F.lit(0.9).alias("probability"))).alias("words"))
    rows = v.segments.join(
        words.withColumnRenamed("seg_index", "index"), ["run_id", "index"])
    segments = _ordered(rows, "index", "segments",
                        [c("index"), c("start"), c("end"), c("text"), c("words")])
    return segments.join(v.runs, "run_id").select("run_id", damaged([
        F.lit("es").alias("language"), c("duration").alias("duration_seconds"),
        F.lit("small").alias("model"), F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        c("segments")], rules.TRANSCRIPT_SCHEMA_VERSION).alias("document"))


@plan("src_transcripts", f"""
SELECT run_id, verdict, CASE WHEN verdict = 'ok' THEN n END AS segments,
  CASE WHEN verdict = 'ok' THEN w END AS words FROM (
  SELECT r.run_id, {_DAMAGE} AS verdict,
    (SELECT count(*) FROM q_segments g WHERE g.run_id = r.run_id) AS n,
    (SELECT count(*) FROM q_words x WHERE x.run_id = r.run_id) AS w FROM q_runs r)""")
def src_transcripts(v: Views) -> DataFrame:
    ok = F.col("problem").isNull()
    words = F.aggregate("doc.segments", F.lit(0), lambda n, s: n + F.size(s["words"]))
    return _verdicts(
        S.parse(transcript_documents(v), S.TRANSCRIPT),
        F.when(ok, F.size("doc.segments")).cast("bigint").alias("segments"),
        F.when(ok, words).cast("bigint").alias("words"))


@plan("src_transcript_segments", f"""
SELECT run_id, idx AS index, start_ms, end_ms, text FROM q_segments WHERE {_SOUND}""")
def src_transcript_segments(v: Views) -> DataFrame:
    return S.transcript_segments(S.parse(transcript_documents(v), S.TRANSCRIPT)).select(
        "run_id", "index", ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"),
        "text")


def batch_documents(v: Views) -> DataFrame:
    c = F.col
    proposal = F.struct(
        "start", "end", "category", "topic", "hook", "summary", "reason", "scores",
        F.array().cast("array<string>").alias("warnings"))
    batches = v.proposals.groupBy("run_id", "chunk_id", "chunk_index").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", proposal.alias("p")))),
        lambda e: e["p"]).alias("candidates"))
    failed = (c("run_id") + c("chunk_index")) % 7 == 0
    both = (c("run_id") % 13 == 0) & (c("chunk_index") == 0)
    twice = (c("run_id") % 13 == 1) & (c("chunk_index") == 1)
    rows = batches.select(
        "run_id", "chunk_index",
        F.when(twice, F.lit("chunk_0000")).otherwise(c("chunk_id")).alias("chunk_id"),
        F.lit("text").alias("raw_response"),
        F.when(failed & ~both, F.filter("candidates", lambda x: F.lit(False)))
        .otherwise(c("candidates")).alias("candidates"),
        F.when(failed | both, F.lit("timed out")).alias("error"))
    docs = _ordered(rows, "chunk_index", "batches",
                    [c("chunk_id"), c("raw_response"), c("candidates"), c("error")])
    return docs.select(
        "run_id", damaged([F.lit("m").alias("model"), c("batches")], 1).alias("document"))


part("q_batch_verdicts", f"""
SELECT run_id, CASE WHEN run_id % 11 <= 4 THEN {_DAMAGE}
  WHEN run_id % 13 = 1 AND n > 1 THEN 'chunk_answered_twice'
  WHEN run_id % 13 = 0 THEN 'failed_and_answered' ELSE 'ok' END AS verdict
FROM (SELECT run_id, count(*) AS n FROM q_chunks GROUP BY run_id)""")


@plan("src_provider_batches", """
SELECT c.run_id, c.chunk_id, p.ordinal, p.ps AS start_ms, p.category,
  CASE WHEN p.ordinal IS NULL THEN 'timed out' END AS error
FROM q_chunks c JOIN q_batch_verdicts b ON b.run_id = c.run_id AND b.verdict = 'ok'
LEFT JOIN q_proposals p ON p.run_id = c.run_id AND p.chunk_id = c.chunk_id
  AND (c.run_id + c.chunk_index) % 7 <> 0""")
def src_provider_batches(v: Views) -> DataFrame:
    return S.batch_candidates(S.parse(batch_documents(v), S.BATCHES)).select(
        "run_id", "chunk_id", "ordinal", ms(F.col("start")).alias("start_ms"), "category",
        "error")


@plan("src_provider_batch_verdicts", "SELECT run_id, verdict FROM q_batch_verdicts")
def src_provider_batch_verdicts(v: Views) -> DataFrame:
    return _verdicts(S.parse(batch_documents(v), S.BATCHES))


@plan("src_candidate_sets", f"""
SELECT run_id, candidate_id, rank, round(fs * 1000)::BIGINT AS start_ms,
  round(fe * 1000)::BIGINT AS end_ms, total AS total_score FROM q_selected WHERE {_SOUND}""")
def src_candidate_sets(v: Views) -> DataFrame:
    c = F.col
    docs = _ordered(v.selected, "rank", "candidates", [
        c("candidate_id").alias("id"), c("rank"), c("start"), c("end"), c("total_score"),
        c("status")]).select("run_id", damaged(
            [F.size("candidates").cast("bigint").alias("proposed"), c("candidates")], 1).alias("document"))
    return S.rows_of(S.parse(docs, S.CANDIDATES), "candidates").select(
        "run_id", c("id").alias("candidate_id"), "rank", ms(c("start")).alias("start_ms"),
        ms(c("end")).alias("end_ms"), "total_score")


@plan("src_chunk_sets", f"""
SELECT run_id, chunk_id, round(s * 1000)::BIGINT AS start_ms, round(e * 1000)::BIGINT AS end_ms
FROM q_chunks WHERE {_SOUND}""")
def src_chunk_sets(v: Views) -> DataFrame:
    c = F.col
    docs = _ordered(v.chunks, "chunk_index", "chunks", [
        c("chunk_id").alias("id"), c("chunk_index").alias("index"), c("window_start"),
        c("window_end"), c("start"), c("end")]).select(
            "run_id", damaged([c("chunks")], 1).alias("document"))
    return S.rows_of(S.parse(docs, S.CHUNKS), "chunks").select(
        "run_id", c("id").alias("chunk_id"), ms(c("start")).alias("start_ms"),
        ms(c("end")).alias("end_ms"))


@plan("src_decisions", f"""
SELECT run_id, candidate_id, decision, round(ns * 1000)::BIGINT AS final_start_ms, reason
FROM q_decisions WHERE {_SOUND} AND run_id % 13 <> 0""")
def src_decisions(v: Views) -> DataFrame:
    """Whole documents only: in some runs the update precedes the creation."""
    c = F.col
    updated = F.when(c("run_id") % 13 == 0, F.lit("2023-01-01T00:00:00Z")).otherwise(
        F.lit("2024-01-02T00:00:00Z"))
    docs = _ordered(v.decisions, "rank", "decisions", [
        c(n) for n in ("candidate_id", "decision", "original_start", "original_end",
                       "final_start", "final_end", "reason", "detail", "reviewed_at")]
    ).join(v.runs, "run_id").select("run_id", damaged([
        c("duration").alias("source_duration_seconds"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), updated.alias("updated_at"),
        c("decisions")], 1).alias("document"))
    return S.rows_of(S.parse(docs, S.DECISIONS), "decisions").select(
        "run_id", "candidate_id", "decision", ms(c("final_start")).alias("final_start_ms"),
        "reason")


@plan("src_output_indexes", f"""
SELECT run_id, candidate_id, rank, sha AS sha256 FROM q_index_full WHERE {_SOUND}""")
def src_output_indexes(v: Views) -> DataFrame:
    c = F.col
    docs = _ordered(clip_index(v), "rank", "clips", [
        c("candidate_id"), c("rank"), c("start"), c("end"), F.lit("clip.mp4").alias("filename"),
        c("sha256")]).select("run_id", damaged([
            F.lit(1080).alias("width"), F.lit(1920).alias("height"), c("clips")], 2)
            .alias("document"))
    return S.rows_of(S.parse(docs, S.CLIP_INDEX), "clips").select(
        "run_id", "candidate_id", "rank", "sha256")


@plan("src_preview_indexes", f"""
SELECT run_id, candidate_id, rank FROM q_selected WHERE {_SOUND} AND run_id % 13 <> 2""")
def src_preview_indexes(v: Views) -> DataFrame:
    """Preview indexes; in some runs the ranks do not start at one."""
    c = F.col
    rank = F.when(c("run_id") % 13 == 2, c("rank") + 1).otherwise(c("rank"))
    docs = _ordered(v.selected.withColumn("rank", rank), "rank", "previews", [
        c("candidate_id"), c("rank"), c("start"), c("end"), F.lit("x.mp4").alias("filename"),
        F.sha2("candidate_id", 256).alias("sha256")]).select("run_id", damaged([
            F.lit(540).alias("width"), F.lit(960).alias("height"), c("previews")], 1)
            .alias("document"))
    return S.rows_of(S.parse(docs, S.PREVIEW_INDEX), "previews").select(
        "run_id", "candidate_id", "rank")


@plan("src_manifests", f"""
SELECT run_id, stage, completed_at FROM q_records WHERE {_SOUND}""")
def src_manifests(v: Views) -> DataFrame:
    """Manifests of exactly schema version 2, one row per completed stage."""
    c = F.col
    value = F.struct(
        F.lit("f").alias("fingerprint"), F.lit("c").alias("stage_config_sha256"),
        F.lit(1).alias("schema_version"),
        F.date_format(
            F.to_utc_timestamp(F.timestamp_seconds("completed_at"), F.current_timezone()),
            "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at"))
    docs = stage_records(v).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("stage", value.alias("v")))).alias("stages")
    ).select("run_id", damaged([
        F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("COMPLETED").alias("status"),
        F.lit("c").alias("config_sha256"), c("stages")], rules.MANIFEST_SCHEMA_VERSION)
        .alias("document"))
    return S.stage_records(S.parse(docs, S.MANIFEST)).select(
        "run_id", "stage", F.unix_seconds(F.to_timestamp("completed_at")).alias("completed_at"))


@plan("src_stage_configs", f"""
SELECT run_id, name, value FROM q_settings WHERE {_SOUND}""")
def src_stage_configs(v: Views) -> DataFrame:
    c = F.col
    docs = settings(v).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("settings")
    ).select("run_id", damaged(
        [F.lit("analysis").alias("stage"), c("settings")], 1).alias("document"))
    return S.accepted(S.parse(docs, S.STAGE_CONFIG)).select(
        "run_id", F.explode("settings").alias("name", "value"))


_WORDS = ('[{"word":"a","start":0.0,"end":0.2,"probability":0.5},'
          '{"word":"b","start":0.2,"end":0.4,"probability":null}]')
_SCORED = ",".join(f'"{n}":70' for n in rules.SCORE_NAMES)
_ONE_FILE = ('{"candidate_id":"cand_1","rank":1,"start":1.0,"end":30.0,"filename":"clip-1.mp4",'
             f'"sha256":"{"0a" * 32}"' + "}")
#: Sound documents of each kind (the run's id and length are put in), and what breaks one rule of
#: each: its name, a piece of the text, and what stands there instead.
VALUE_FAULTS: dict[str, tuple[S.Kind, str, tuple[tuple[str, str, str], ...]]] = {
    "transcript": (S.TRANSCRIPT, (
        '{"schema_version":%d,"run_id":RUN,"language":"es","language_probability":0.98,'
        '"duration_seconds":LENGTH,"model":"small","created_at":"2024-01-01T00:00:00Z",'
        '"segments":[{"index":0,"start":0.0,"end":0.4,"text":"a b","words":%s}]}') % (
            rules.TRANSCRIPT_SCHEMA_VERSION, _WORDS), (
        ("probability_out_of_range", '"probability":0.5', '"probability":7'),
        ("probability_out_of_range", "0.98", "9"),
        ("words_not_sorted", '"start":0.2', '"start":-0.0,"end":0.1},{"word":"c","start":0.3,'
                             '"end":0.3},{"word":"d","start":0.1'),
        ("timestamp_not_utc", "2024-01-01", "2024-99-01"),
        ("not_finite", "LENGTH", "1e400"),
        ("duration_not_positive", "LENGTH", "0"),
        ("word_outside_segment", '"end":0.2', '"end":0.9'),
        ("wrong_shape", '"index":0', '"index":"0"'))),
    "batches": (S.BATCHES, (
        '{"schema_version":1,"run_id":RUN,"model":"m","batches":[{"chunk_id":"chunk_0000",'
        '"raw_response":"text","model":"m","candidates":[{"start":1.0,"end":LENGTH,'
        '"category":"tip","topic":"t","hook":"h","summary":"s","reason":"r",'
        '"scores":{%s},"warnings":[]}]}]}') % _SCORED, (
        ("rating_out_of_range", '"clarity":70', '"clarity":900'),
        ("rating_out_of_range", '"hook":70', '"hook":-1'),
        ("unknown_category", '"tip"', '"zzz"'),
        ("text_out_of_bounds", '"topic":"t"', '"topic":"' + "t" * 500 + '"'),
        ("text_out_of_bounds", '"hook":"h"', '"hook":""'),
        ("too_many_warnings", "[]", "[" + ",".join(['"w"'] * 21) + "]"),
        ("other_model", '"model":"m","candidates"', '"model":"n","candidates"'),
        ("name_missing", '"chunk_0000"', '""'),
        ("not_finite", '"start":1.0', '"start":1e999'))),
    "candidates": (S.CANDIDATES, (
        '{"schema_version":1,"run_id":RUN,"proposed":3,"candidates":[{"id":"cand_1","rank":1,'
        '"start":0.0,"end":LENGTH,"total_score":80.5,"status":"suggested"},{"id":"cand_2",'
        '"rank":2,"start":0.0,"end":LENGTH,"total_score":70,"status":"suggested"}]}'), (
        ("proposed_too_few", '"proposed":3', '"proposed":0'),
        ("unsafe_identifier", '"cand_1"', '"../x"'),
        ("score_out_of_range", "80.5", "800.5"),
        ("ranks_not_contiguous", '"rank":2', '"rank":3'),
        ("listed_twice", "cand_2", "cand_1"))),
    "chunks": (S.CHUNKS, (
        '{"schema_version":1,"run_id":RUN,"chunks":[{"id":"chunk_0000","index":0,'
        '"window_start":0.0,"window_end":120.0,"start":0.0,"end":LENGTH}]}'), (
        ("unsafe_identifier", "chunk_0000", "chunk 0"),
        ("not_ordered", '"window_end":120.0', '"window_end":0.0'),
        ("not_finite", "120.0", "1e400"))),
    "decisions": (S.DECISIONS, (
        '{"schema_version":1,"run_id":RUN,"source_duration_seconds":LENGTH,'
        '"created_at":"2024-01-01T00:00:00Z","updated_at":"2024-01-02T00:00:00Z","decisions":['
        '{"candidate_id":"cand_1","decision":"rejected","original_start":0.0,"original_end":0.1,'
        '"reason":"other","detail":"note","reviewed_at":"2024-01-01T10:00:00Z"}]}'), (
        ("other_needs_detail", '"note"', '" "'),
        ("other_needs_detail", ',"detail":"note"', ""),
        ("detail_without_reason", '"reason":"other",', ""),
        ("detail_too_long", '"note"', '"' + "d" * 3000 + '"'),
        ("original_beyond_source", '"original_end":0.1', '"original_end":1e12'),
        ("rejected_with_interval", '"reason"', '"final_start":0.0,"reason"'),
        ("reason_without_rejection", '"rejected"', '"approved","final_start":0.0,"final_end":0.1'))),
    "clips": (S.CLIP_INDEX, (
        '{"schema_version":2,"run_id":RUN,"width":1080,"height":1920,"clips":[%s]}') % _ONE_FILE, (
        ("unsafe_identifier", "cand_1", "../x"), ("unsafe_filename", "clip-1.mp4", "/etc/passwd"),
        ("bad_digest", "0a" * 32, "zz"), ("dimensions_not_positive", "1080", "0"))),
    "previews": (S.PREVIEW_INDEX, (
        '{"schema_version":1,"run_id":RUN,"width":540,"height":960,"previews":[%s]}') % _ONE_FILE, (
        ("unsafe_identifier", "cand_1", "a/b"), ("unsafe_filename", "clip-1.mp4", "..mp4"),
        ("bad_digest", "0a" * 32, "0A" * 32), ("ranks_not_contiguous", '"rank":1', '"rank":2'))),
}


@plan("src_value_rules", " UNION ALL ".join(
    f"""SELECT run_id, '{name}' AS kind, {["ok", *[f[0] for f in faults]]}
  [1 + run_id % {len(faults) + 1}] AS verdict FROM q_runs""" for name, (_, _, faults) in VALUE_FAULTS.items()))
def src_value_rules(v: Views) -> DataFrame:
    """A document of every kind and run, each with one value that its kind forbids, or sound."""
    made = []
    for name, (kind, sound, faults) in VALUE_FAULTS.items():
        f = (F.col("run_id") % (len(faults) + 1)).cast("int")
        old = F.element_at(F.array(*[F.lit(x) for x in ("", *[f[1] for f in faults])]), f + 1)
        new = F.element_at(F.array(*[F.lit(x) for x in ("", *[f[2] for f in faults])]), f + 1)
        text = F.when(f == 0, F.lit(sound)).otherwise(F.replace(F.lit(sound), old, new))
        text = F.replace(text, F.lit("RUN"), F.col("run_id").cast("string"))
        text = F.replace(text, F.lit("LENGTH"), F.col("duration").cast("string"))
        docs = v.runs.select("run_id", text.alias("document"))
        made.append(_verdicts(S.parse(docs, kind), F.lit(name).alias("kind")))
    return functools.reduce(DataFrame.unionByName, made)


@plan("content_digests", """
SELECT 'document' AS kind, doc_id AS id, strlen(text)::BIGINT AS size_bytes, sha256(text) AS sha256
FROM documents
UNION ALL SELECT 'page', page_id, strlen(html)::BIGINT, sha256(html) FROM pages""")
def content_digests(v: Views) -> DataFrame:
    """Size and digest of every text and page: what file_digests gives for files."""
    def rows(table: str, kind: str, key: str, text: str) -> DataFrame:
        return v.table(table).select(
            F.lit(kind).alias("kind"), F.col(key).alias("id"),
            F.octet_length(text).cast("bigint").alias("size_bytes"), F.sha2(text, 256).alias("sha256"))

    return rows("documents", "document", "doc_id", "text").unionByName(
        rows("pages", "page", "page_id", "html"))


@plan("src_file_digests")
def src_file_digests(v: Views) -> DataFrame:
    """Inventory of the given files themselves."""
    return S.file_digests(v.spark, f"{v.folder}/*.parquet")


@plan("src_media_probe", """
SELECT run_id, candidate_id, CASE f WHEN 0 THEN 'no_video' WHEN 1 THEN 'no_audio'
  WHEN 3 THEN 'no_duration' WHEN 4 THEN 'duration_not_positive' WHEN 5 THEN 'incomplete'
  WHEN 12 THEN 'not_json' ELSE 'ok' END AS verdict,
  CASE WHEN f IN (0, 1, 3, 4, 5, 12) THEN NULL ELSE 10 + x % 50 END AS duration_seconds,
  CASE WHEN f IN (0, 1, 3, 4, 5, 12) THEN NULL WHEN f = 6 THEN 25.0::DOUBLE WHEN f = 7 THEN 0.0
    ELSE 30000.0::DOUBLE / 1001 END AS fps,
  CASE WHEN f IN (0, 1, 3, 4, 5, 12, 8, 9) THEN NULL ELSE '1:1' END AS sample_aspect_ratio,
  CASE WHEN f IN (0, 1, 3, 4, 5, 12) OR f = 10 THEN NULL ELSE 44100 END AS sample_rate
FROM (SELECT run_id, candidate_id, x, x % 13 AS f FROM q_index_full)""")
def src_media_probe(v: Views) -> DataFrame:
    c = F.col
    index = clip_index(v).select("run_id", "candidate_id", "x", (c("x") % 13).alias("f"))
    f = c("f")
    length = (10 + c("x") % 50).cast("string")
    video = F.concat(
        F.lit('{"codec_type":"video","codec_name":"h264"'),
        F.when(f == 5, F.lit("")).otherwise(F.lit(',"width":640')),
        F.lit(',"height":360,"avg_frame_rate":"'),
        F.when(f.isin(6, 7), F.lit("0/0")).otherwise(F.lit("30000/1001")),
        F.lit('","r_frame_rate":"'), F.when(f == 6, F.lit("25/1")).otherwise(F.lit("0/0")),
        F.lit('","sample_aspect_ratio":"'),
        F.when(f == 8, F.lit("N/A")).when(f == 9, F.lit("0:1")).otherwise(F.lit("1:1")),
        F.lit('","duration":"'), F.when(f == 3, F.lit("")).otherwise(length), F.lit('"}'))
    audio = F.concat(
        F.lit('{"codec_type":"audio","codec_name":"aac","channels":2'),
        F.when(f == 10, F.lit("")).otherwise(F.lit(',"sample_rate":"44100"')), F.lit("}"))
    stated = F.when(f.isin(2, 3), F.lit("")).when(f == 4, F.lit('"duration":"0.0",')).otherwise(
        F.concat(F.lit('"duration":"'), length, F.lit('",')))
    streams = F.when(f == 0, audio).when(f == 1, video).otherwise(
        F.concat_ws(",", audio, video))
    doc = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":{'), stated,
                   F.lit('"format_name":"mp4"}}'))
    docs = index.withColumn("document", F.when(f == 12, F.lit("{\"streams\":[")).otherwise(doc))
    ok = c("problem").isNull()
    return M.probe_media(docs).select(
        "run_id", "candidate_id", F.coalesce("problem", F.lit("ok")).alias("verdict"),
        F.when(ok, c("duration_seconds")).cast("bigint").alias("duration_seconds"),
        F.when(ok, c("fps")).alias("fps"),
        F.when(ok, c("sample_aspect_ratio")).alias("sample_aspect_ratio"),
        F.when(ok, c("sample_rate")).alias("sample_rate"))


@plan("sink_tables", """
SELECT r.run_id, proposed, selected, coalesce(decided, 0) AS decided FROM (
  SELECT run_id, count(*) AS proposed, count_if(outcome = 'selected')::BIGINT AS selected
  FROM q_outcomes GROUP BY run_id) r
LEFT JOIN (SELECT run_id, count(*) AS decided FROM q_decisions GROUP BY run_id) d USING (run_id)""")
def sink_tables(v: Views) -> DataFrame:
    """Two tables published as one version after all checks, and read back by its mark."""
    root = f"{shared_folder(v.spark)}/published-{uuid.uuid4().hex}"
    sound = R.decision_problems(v.decisions, v.runs).where(F.size("problems") > 0)
    publish(v.spark, root, {"funnel": funnel(v.outcomes).select("run_id", "proposed", "selected"),
                            "decisions": v.decisions.select("run_id", "candidate_id", "decision")},
            {"unsound decisions": sound})
    found = published(v.spark, root)
    decided = found["decisions"].groupBy("run_id").agg(F.count("*").alias("decided"))
    return found["funnel"].join(decided, "run_id", "left").withColumn(
        "decided", F.coalesce("decided", F.lit(0).cast("bigint")))
