"""Caption grouping, timing, wrapping, stamps and documents."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from cliploom.functions import columns as C
from cliploom.operators import captions as K
from cliploom.operators import documents as D

WORDS = "run_id long, seg_index long, word_pos long, word string, start double, end double"


def cues_by_loop(words, a, b):
    """Sequential captions written for this test."""
    tokens = sorted(((s, e, i, w) for i, (w, s, e) in enumerate(words)
                     if e - a > 1e-9 and b - s > 1e-9))
    toks = [(w, max(s, a) - a, max(min(e, b) - a, max(s, a) - a)) for s, e, _, w in tokens]
    groups = []
    for w, s, e in toks:
        if groups:
            g = groups[-1]
            last = g[-1][0].rstrip("\"')]»”")
            size = sum(len(x[0]) for x in g) + len(g) + len(w)
            if (len(g) >= 8 or last[-1:] in (*".?!…",) and last or s - g[-1][2] >= 0.6
                    or len(g) >= 6 and last[-1:] in (*",;:",) and last or size > 84):
                groups.append([])
        else:
            groups.append([])
        groups[-1].append((w, s, e))
    spans = [(min(x[1] for x in g), max(x[2] for x in g), [x[0] for x in g]) for g in groups]
    out, prev, clip = [], 0.0, b - a
    for i, (s, e, ws) in enumerate(spans):
        s = min(max(s, prev), clip)
        e = min(max(e, s), clip)
        limit = min(max(spans[i + 1][0] if i + 1 < len(spans) else clip, s), clip)
        if e - s < 0.25:
            e = min(s + 0.25, limit)
        if e - s <= 1e-9:
            continue
        out.append((s, e, " ".join(ws)))
        prev = e
    return out


def test_cues_equal_loop_with_overlapping_words(spark):
    rng = random.Random(8)
    rows, clips, want = [], [], {}
    for run in range(60):
        t, words = 0.0, []
        for i in range(rng.randrange(0, 90)):
            w = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14)))
            w += rng.choice(["", "", "", "", ",", ".", '."', "?)", "…", ";»"])
            e = round(t + rng.choice([0.0, 0.05, 0.3, 1.5, 2.5]), 2)
            words.append((w, t, e))
            t = round(t + rng.choice([0.0, 0.01, 0.2, 0.4, 1.0]), 2)
        a = round(rng.uniform(0, 5), 2)
        b = a + rng.choice([3.0, 20.0, 45.0])
        rows += [(run, 0, i, *w) for i, w in enumerate(words)]
        clips.append((run, f"c{run}", a, b))
        want[run] = cues_by_loop(words, a, b)
    got = {}
    cues = K.build_cues(
        spark.createDataFrame(rows, WORDS).repartition(6),
        spark.createDataFrame(clips, "run_id long, candidate_id string, start double, end double"))
    for r in cues.orderBy("run_id", "index").collect():
        got.setdefault(r.run_id, []).append((r.start, r.end, " ".join(r.lines)))
    assert {k: v for k, v in want.items() if v} == got


@pytest.mark.parametrize("words,lines", [
    (["a" * 50], ["a" * 50]),
    (["short", "line"], ["short line"]),
    (["aaaaaaaaaa"] * 4 + ["b"] * 2, ["aaaaaaaaaa aaaaaaaaaa", "aaaaaaaaaa aaaaaaaaaa b b"]),
    (["x" * 21, "y" * 21], ["x" * 21, "y" * 21]),
])
def test_wrap(spark, words, lines):
    df = spark.createDataFrame([(words,)], "words array<string>")
    assert df.select(K.wrap_lines(F.col("words"))).first()[0] == lines


def test_half_up_units(spark):
    values = [.0005, .0015, .0025, 1.2345, 1.2344, 1.0005, .005, .015, .025, 1.234, 1.236, 0.0, -1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for unit in (1000, 100):
        want = [max(0, int((Decimal(repr(v)) * unit).quantize(Decimal(1), rounding=ROUND_HALF_UP)))
                for v in values]
        assert [r[0] for r in df.select(C.half_up_units(F.col("x"), unit)).collect()] == want


def test_two_decimals_as_c_prints_them(spark):
    rng = random.Random(6)
    values = [round(rng.uniform(0, 40000), 3) for _ in range(3000)] + [
        0.125, 0.375, 0.625, 2.675, 22.255, 1.005, 0.0, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(C.fixed2(F.col("x"))).collect()] == [f"{v:.2f}" for v in values]


def test_stamps(spark):
    df = spark.createDataFrame([(3661123, 366112)], "m long, c long")
    assert tuple(df.select(C.srt_stamp(F.col("m")), C.ass_stamp(F.col("c"))).first()) == (
        "01:01:01,123", "1:01:01.12")


def test_documents_round_trip(spark):
    rows = [(1, "a", i + 1, i * 2.0 + 0.1234, i * 2.0 + 1.0, [f"line, {i}", "{x} \\ y"]) for i in range(5)]
    cues = spark.createDataFrame(
        rows, "run_id long, candidate_id string, index long, start double, end double, lines array<string>")
    clips = spark.createDataFrame([(1, "a", 5.0, 25.0), (1, "silent", 30.0, 40.0)],
                                  "run_id long, candidate_id string, start double, end double")
    srt, ass = D.clip_srt(cues, clips), D.clip_ass(cues, clips, 1080, 1920)
    events = D.events_of(D.parse_srt(srt)).orderBy("position").collect()
    assert [(e.start_ms, e.end_ms, e.text) for e in events] == [
        (i * 2000 + 123, i * 2000 + 1000, "\n".join(r[5])) for i, r in enumerate(rows)]
    events = D.events_of(D.parse_ass(ass)).orderBy("position").collect()
    assert events[0].start_ms == 120 and events[0].text == "line, 0\n(x) / y"
    docs = {r.candidate_id: r.document for r in srt.collect()}
    assert docs["silent"] == ""
    problems = D.event_problems(D.parse_srt(srt), clips).collect()
    assert all(p.problem is None for p in problems)
    short = clips.withColumn("end", F.col("start") + 4.0)
    marks = {p.candidate_id: p.problem for p in D.event_problems(D.parse_srt(srt), short).collect()}
    assert marks == {"a": "past_clip_end", "silent": None}


def test_long_transcript_parts_join_to_the_document(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 3)
    df = spark.createDataFrame([(1, i, i * 1.0, i + 0.5, f"s{i}") for i in range(8)],
                               "run_id long, index long, start double, end double, text string")
    text = "".join(r.text for r in D.transcript_text(df).orderBy("part").collect())
    assert text == "".join(f"s{i}\n" for i in range(8))
    srt = "".join(r.text for r in D.transcript_srt(df).orderBy("part").collect())
    assert srt.count(" --> ") == 8 and "\n\n8\n00:00:07,000" in srt and srt.endswith("s7\n")


def test_documents_of_stored_clips_are_made_where_they_lie(spark, tmp_path):
    rows = [(1, "a", [(1, 0.5, 2.0, ["one", "two"]), (2, 2.0, 3.5, ["three"])]), (1, "silent", [])]
    kind = "array<struct<index:bigint,start:double,end:double,lines:array<string>>>"
    spark.createDataFrame(rows, f"run_id long, candidate_id string, cues {kind}").write.parquet(f"{tmp_path}/c")
    stored = spark.read.parquet(f"{tmp_path}/c")
    clips = stored.select("run_id", "candidate_id")
    for made, by_rows in ((D.srt_documents(stored), D.clip_srt(stored.selectExpr(
            "run_id", "candidate_id", "inline(cues)"), clips)),
            (D.ass_documents(stored, 1080, 1920), D.clip_ass(stored.selectExpr(
                "run_id", "candidate_id", "inline(cues)"), clips, 1080, 1920))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(made.collect()) == sorted(by_rows.collect())


def test_documents_meet_clips_without_their_events(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {"fine": [(0, 900), (900, 2000)], "late": [(0, 900), (900, 2001), (100, 300)],
                "early": [(0, 900), (899, 5000)], "empty": [], "negative": [(-1, 5)], "bad": [(0, 9000)]}
        parsed = spark.createDataFrame(
            [(1, name, [(a, b, "t") for a, b in events], "no_text" if name == "bad" else None)
             for name, events in rows.items()],
            "run_id long, candidate_id string, events array<struct<start_ms:bigint,end_ms:bigint,text:string>>, "
            "problem string")
        clips = spark.createDataFrame([(1, name, 1.0, 3.0) for name in rows],
                                      "run_id long, candidate_id string, start double, end double")
        found = D.event_problems(parsed, clips)
        assert {r.candidate_id: r.problem for r in found.collect()} == {
            "fine": None, "late": "past_clip_end", "early": "out_of_order", "empty": None,
            "negative": "out_of_order", "bad": "unreadable"}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "AS _reach" in plan[plan.index("Join Inner"):].splitlines()[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
