"""Replies, decisions, states, sources, sinks and digests."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.operators import digests, replies, review
from cliploom.sources import documents as S
from cliploom.sources import sinks

GOOD = ('{"start":1,"end":2.5,"category":"tip","topic":"t","hook":"h","summary":"s","reason":"r",'
        '"scores":{"hook":1,"value":2,"context_independence":3,"clarity":4,'
        '"engagement_potential":5,"relevance":6}}')


@pytest.mark.parametrize("body,problem", [
    ('{"candidates":[%s]}' % GOOD, None), ('{"candidates":[]}', None), (" \n", "empty"),
    ("nope", "not_json"), ('{"candidates":[]} x', "not_json"), ("[1]", "not_object"),
    ("null", "not_object"), ('{"candidates":{}}', "schema"), ('{"candidates":[1]}', "schema"),
    ('{"candidates":[],"x":1}', "schema"),
    ('{"candidates":[%s]}' % GOOD.replace('"hook":1', '"hook":101'), "schema"),
    ('{"candidates":[%s]}' % GOOD.replace('"hook":1', '"hook":92.0'), None),
    ('{"candidates":[%s]}' % GOOD.replace('"hook":1', '"hook":92.5'), "schema"),
    ('{"candidates":[%s]}' % GOOD.replace('"start":1', '"start":NaN'), "schema"),
    ('{"candidates":[%s]}' % GOOD.replace('"start":1', '"start":-9'), None),
    ('{"candidates":[%s,%s]}' % (GOOD, GOOD.replace("tip", "dance")), "schema"),
    ('{"candidates":[%s]}' % GOOD.replace('"topic":"t"', '"topic":"%s"' % ("t" * 200)), None),
    ('{"candidates":[%s]}' % GOOD.replace('"topic":"t"', '"topic":"%s"' % ("t" * 201)), "schema"),
    ('{"candidates":[%s]}' % ",".join([GOOD] * 200), None),
    ('{"candidates":[%s]}' % ",".join([GOOD] * 201), "schema"),
])
def test_replies(spark, body, problem):
    df = spark.createDataFrame([(1, "chunk_0000", body)],
                               "run_id long, chunk_id string, raw_response string")
    assert replies.check_replies(df).first().problem == problem


DECISION = dict(run_id=1, candidate_id="a", decision="approved", original_start=1.0,
                original_end=30.0, final_start=1.0, final_end=30.0, reason=None, detail=None,
                reviewed_at="2024-01-01T00:00:00Z")
REJECTED = dict(decision="rejected", final_start=None, final_end=None)
COLUMNS = ("run_id long, candidate_id string, decision string, original_start double, "
           "original_end double, final_start double, final_end double, reason string, "
           "detail string, reviewed_at string")


@pytest.mark.parametrize("change,problems", [
    ({}, []),
    ({"final_end": 30.0 + 5e-7}, []),
    ({"final_end": 30.1}, ["approved_moved"]),
    ({"decision": "edited"}, ["edited_not_moved"]),
    ({"decision": "edited", "final_start": 0.5}, []),
    ({"decision": "edited", "final_start": 40.0}, ["edited_not_ordered"]),
    ({"decision": "edited", "final_end": 101.0}, ["ends_beyond_source"]),
    (REJECTED, []),
    ({**REJECTED, "reason": "other"}, ["other_needs_detail"]),
    ({**REJECTED, "reason": "other", "detail": "why"}, []),
    ({**REJECTED, "detail": "why"}, ["detail_without_reason"]),
    ({"decision": "rejected"}, ["rejected_with_interval"]),
    ({"reviewed_at": "2024-01-01T00:00:00+02:00"}, ["timestamp_not_utc"]),
    ({"reviewed_at": "2024-01-01T00:00:00"}, ["timestamp_not_utc"]),
    ({"reviewed_at": "2024-01-01T00:00:00+00:00"}, []),
])
def test_decisions(spark, change, problems):
    row = {**DECISION, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in COLUMNS.split(", "))], COLUMNS)
    runs = spark.createDataFrame([(1, 100.0)], "run_id long, duration double")
    assert list(review.decision_problems(df, runs).first().problems) == problems


def test_identity_follows_the_prompt_text(spark):
    one = spark.range(1).select(
        digests.prompt_digest("a\r\nb").alias("x"), digests.prompt_digest("a\nb").alias("y"),
        digests.prompt_digest("a\nc").alias("z")).first()
    assert one.x == one.y != one.z


def test_state_table():
    moves = {f"{a}>{b}" for a, ends in rules.STATUS_MOVES.items() for b in ends}
    assert rules.STATUS_MOVES.keys() < set(rules.RUN_STATUSES)
    assert "CREATED>INSPECTED" in moves and "REVIEWED>READY_FOR_REVIEW" in moves
    assert "CREATED>AUDIO_READY" not in moves and "READY_FOR_REVIEW>ANALYZED" not in moves
    assert "FAILED_RENDER>RENDERED" in moves and "FAILED_RENDER>FAILED_RENDER" in moves
    assert "COMPLETED>RENDERED" not in moves
    assert len(moves) == 8 + 7 * 4 + 1


def test_documents_from_files(spark, tmp_path):
    good = ('{"schema_version":1,"run_id":1,"language":"es","duration_seconds":9.5,"model":"m",'
            '"created_at":"2024-01-01T00:00:00Z","segments":[{"index":0,"start":0.0,"end":1.0,"text":"a","words":[]}]}')
    cases = {
        "a": (good, None), "b": (good[:40], "not_json"), "c": (f"[{good}]", "not_object"),
        "d": (good.replace('version":1', 'version":2'), "schema_version"),
        "e": (good.replace('"model":"m",', ""), "missing_field"),
        "f": (good.replace('{"schema', '{"x":1,"schema'), "unknown_field"),
        "g": (good.replace('"index":0', '"index":1'), "indices_not_contiguous"),
        "h": (good.replace('"end":1.0', '"end":10.0'), "beyond_duration"),
        "i": (good.replace("9.5", '"abc"'), "wrong_shape"),
        "j": (good.replace("9.5", "null"), "wrong_shape"),
        "k": (good.replace("9.5", "NaN"), "not_json"),
        "l": (re.sub(r'"segments":.*', '"segments":"none"}', good), "wrong_shape"),
        "m": (good.replace('"text":"a"', '"text":"a","note":1'), "wrong_shape"),
        "n": (good.replace('"start":0.0', '"start":"x"'), "wrong_shape"),
        "o": (good.replace("00Z", "00"), "timestamp_not_utc"),
        "p": (good.replace('"words":[]', '"words":[{"word":"w","start":0.5,"end":2}]'),
              "word_outside_segment"),
        "q": (good.replace('"end":1.0', '"end":-1.0'), "segment_not_ordered"),
        "r": (good.replace('"words":[]', '"words":[{"word":"w","start":0.5,"end":1}]'), None),
    }
    for name, (body, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(body)
    parsed = S.parse(S.read_files(spark, f"{tmp_path}/*.json"), S.TRANSCRIPT)
    got = {r.path[-6]: r.problem for r in parsed.collect()}
    assert got == {k: v for k, (_, v) in cases.items()}
    assert S.transcript_segments(parsed).count() == 2


DECIDED = {"candidate_id": "c", "decision": "approved", "original_start": 1.0, "original_end": 2.0,
           "final_start": 1.0, "final_end": 2.0, "reviewed_at": "2024-01-01T00:00:00Z"}
REVIEW = {"schema_version": 1, "run_id": 1, "source_duration_seconds": 9,
          "created_at": "2024-01-01T00:00:00Z", "updated_at": "2024-01-01T00:00:00Z"}
FILE = {"candidate_id": "c", "rank": 1, "start": 0, "end": 1.5, "filename": "f.mp4", "sha256": "0a" * 32}


@pytest.mark.parametrize("kind,document,problem", [
    (S.DECISIONS, {**REVIEW, "decisions": [DECIDED]}, None),
    (S.DECISIONS, {**REVIEW, "decisions": [{**DECIDED, "decision": "maybe"}]}, "unknown_decision"),
    (S.DECISIONS, {**REVIEW, "decisions": [{**DECIDED, "final_end": 3.0}]}, "approved_moved"),
    (S.DECISIONS, {**REVIEW, "decisions": [{**DECIDED, "reviewed_at": "2024-01-01T00:00:00"}]},
     "timestamp_not_utc"),
    (S.DECISIONS, {**REVIEW, "decisions": [{**DECIDED, "original_start": "x"}]}, "wrong_shape"),
    (S.DECISIONS, {**REVIEW, "decisions": [{**DECIDED, "reason": "other"}]},
     "reason_without_rejection"),
    (S.MANIFEST, {"schema_version": 2, "run_id": "1", "created_at": "2024-01-01T00:00:00Z",
                  "status": "CREATED", "config_sha256": "c", "stages": {}}, "wrong_shape"),
    (S.MANIFEST, {"schema_version": 2, "run_id": 1, "created_at": "2024-01-01T00:00:00Z",
                  "status": "CREATED", "config_sha256": "c", "stages": "bad"}, "wrong_shape"),
    (S.BATCHES, {"schema_version": 1, "run_id": 1, "model": "m", "batches": "x"}, "wrong_shape"),
    (S.CHUNKS, {"schema_version": 1, "run_id": 1, "chunks": 5}, "wrong_shape"),
    (S.CLIP_INDEX, {"schema_version": 2, "run_id": 1, "width": "w", "height": 1, "clips": None},
     "wrong_shape"),
    (S.CLIP_INDEX, {"schema_version": 2, "run_id": 1, "width": 2, "height": 1, "clips": [FILE]},
     None),
    (S.STAGE_CONFIG, {"schema_version": 1, "run_id": 1, "stage": "audio", "settings": []},
     "wrong_shape"),
    (S.CANDIDATES, {"schema_version": 1, "run_id": 1, "proposed": 1, "candidates": [
        {"id": "a", "rank": 1, "start": 0, "end": 1, "total_score": 500, "status": "suggested"}]},
     "score_out_of_range"),
    (S.CANDIDATES, {"schema_version": 1, "run_id": 1, "proposed": 1, "candidates": [
        {"id": "a", "rank": 1, "start": 0, "end": 1, "total_score": 50, "status": "zzz"}]},
     "unknown_status"),
])
def test_documents_are_refused_whole(spark, kind, document, problem):
    docs = spark.createDataFrame([(json.dumps(document),)], "document string")
    assert S.parse(docs, kind).first().problem == problem


def test_partition_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    sinks.write_partitions(df, path, ["p"])
    sinks.write_partitions(spark.createDataFrame([(99, 1)], "id long, p long"), path, ["p"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 4, 6, 8, 99]


def test_tree_digest_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(
        F.lit(1).alias("run_id"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    a = digests.tree_digest(df.repartition(3), ["run_id"], "pos", "d", "x").first().x
    b = digests.tree_digest(df.repartition(11, F.rand(1)), ["run_id"], "pos", "d", "x").first().x
    c = digests.tree_digest(df.where("pos <> 5"), ["run_id"], "pos", "d", "x").first().x
    assert a == b != c


def test_digests_of_large_files_pass_in_pieces(spark, tmp_path, monkeypatch):
    """Random bytes with and without line feeds at the end, over several splits."""
    draw = random.Random(4)
    contents = {"empty": b"", "feed": b"\n", "feeds": b"\n\n\n", "bare": b"abc", "ended": b"abc\n",
                "crlf": b"a\r\nb\r\n\r", "not_text": bytes(draw.randrange(256) for _ in range(50_000)),
                "long": b"x" * 5000 + b"\n" + b"\xff\xfe" * 4000,
                "rows": b"".join(b"%d\n" % draw.randrange(10**6) for _ in range(9_000))}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for one_value in (-1, 6, 10_000, 1 << 28):
            found = S.file_digests(spark, str(tmp_path), one_value).collect()
            assert {r.name: (r.size_bytes, r.sha256) for r in found} == {
                name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()
                if data}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
