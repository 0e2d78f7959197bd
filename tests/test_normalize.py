"""Normalization against a sequential loop, and the block-wise scans under it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import normalize as N
from cliploom.operators import scans

TOL = 0.05 + 1e-9


def loop(segments, words, duration):
    """Sequential reference written for this test: (segments, words) or None when refused."""
    def pull(x, low, high):
        if x < low:
            if low - x > TOL:
                raise ValueError
            x = low
        if x > high:
            if x - high > TOL:
                raise ValueError
            x = high
        return x

    out, out_words, before = [], [], 0.0
    for pos, (s, e, text) in enumerate(segments):
        if not (math.isfinite(s) and math.isfinite(e)):
            raise ValueError
        s = pull(s, before, duration)
        e = pull(e, s, duration)
        before = s
        clean = " ".join(text.split())
        if not clean:
            continue
        out.append((len(out), s, e, clean))
        floor = s
        for wpos, (ws, we) in enumerate(words[pos]):
            ws = pull(ws, floor, e)
            we = pull(we, ws, e)
            floor = ws
            out_words.append((pos, wpos, ws, we))
    return out, out_words


def test_equal_to_loop(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_ROWS", 4)
    rng = random.Random(1)
    raw_seg, raw_word, runs, want = [], [], [], {}
    for run in range(150):
        t, segs, words = 0.0, [], []
        for pos in range(rng.randrange(1, 14)):
            noise = rng.choice([0, 0, 0, 0, -0.03, 0.04, -0.05]) if rng.random() < 0.9 else -0.2
            s = round(t + noise, 3)
            e = round(s + rng.choice([0.0, 0.02, 1.0, 3.0]), 3)
            text = rng.choice([" a  b ", "c", "  ", " d e "])
            segs.append((s, e, text))
            ws = []
            at = s
            for _ in range(rng.randrange(0, 4)):
                w = (round(at + rng.choice([0, 0, -0.03, 0.01]), 3), round(at + 0.02, 3))
                ws.append(w)
                at = w[1]
            words.append(ws)
            t = rng.choice([e, s, s])
        if rng.random() < 0.05:
            segs[-1] = (float("nan"), segs[-1][1], segs[-1][2])
        duration = round(max(x[1] for x in segs) + rng.choice([0.5, -0.03, 0.0]), 3)
        if duration <= 0:
            duration = 0.5
        try:
            want[run] = loop(segs, words, duration)
        except ValueError:
            want[run] = None
        runs.append((run, duration, None, 0.9, 1.0))
        raw_seg += [(run, p, *x) for p, x in enumerate(segs)]
        raw_word += [(run, p, i, "w", *w, 0.9) for p, ws in enumerate(words) for i, w in enumerate(ws)]
    seg = spark.createDataFrame(raw_seg, "run_id long, seg_pos long, start double, end double, text string")
    word = spark.createDataFrame(
        raw_word, "run_id long, seg_pos long, word_pos long, word string, start double, end double, "
                  "probability double")
    run_df = spark.createDataFrame(
        runs, "run_id long, duration double, declared double, language_probability double, "
              "processing_seconds double")
    cs = N.clamp_segments(seg, run_df)
    cw = N.clamp_words(word, cs)
    refused = N.run_problems(run_df, cs, cw)
    got_refused = {r.run_id for r in refused.collect()}
    assert got_refused == {r for r, w in want.items() if w is None}
    assert 10 < len(got_refused) < 140
    got = {}
    for r in N.normalized_segments(cs, refused).collect():
        got.setdefault(r.run_id, []).append((r["index"], r.start, r.end, r.text))
    got_words = {}
    for r in N.normalized_words(cw, refused).collect():
        got_words.setdefault(r.run_id, []).append((r.seg_pos, r.word_pos, r.start, r.end))
    for run, w in want.items():
        if w is not None:
            assert sorted(got.get(run, [])) == w[0]
            assert sorted(got_words.get(run, [])) == sorted(w[1])


def test_first_notes_only(spark):
    n = 30
    seg = spark.createDataFrame([(1, i, 1.0 - (0.01 if i else 0.0), 2.0, "t") for i in range(n)],
                                "run_id long, seg_pos long, start double, end double, text string")
    word = spark.createDataFrame(
        [], "run_id long, seg_pos long, word_pos long, word string, start double, end double, "
            "probability double")
    runs = spark.createDataFrame([(1, 5.0, None, 0.9)],
                                 "run_id long, duration double, declared double, language_probability double")
    cs = N.clamp_segments(seg, runs)
    cw = N.clamp_words(word, cs)
    row = N.report(cs, cw, runs, N.run_problems(runs, cs, cw)).first()
    assert row.clamped_segment_bounds == n - 1
    assert len(row.notes) == 21 and row.notes[-1] == "further normalizations omitted"
    assert row.notes[0] == "segment 1: raised 0.99 to 1.0"


@pytest.mark.parametrize("declared,ok", [(100.5, True), (100.51, False), (None, True), (99.5, True)])
def test_duration_gate(spark, declared, ok):
    df = spark.createDataFrame([(1, 100.0, declared, 0.5)],
                               "run_id long, duration double, declared double, language_probability double")
    assert (N.duration_gate(df).first().problem is None) == ok


@pytest.mark.parametrize("column", ["duration", "declared", "language_probability"])
@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_non_finite_run_values(spark, column, value):
    row = {"run_id": 1, "duration": 10.0, "declared": 10.0, "language_probability": 0.5, column: value}
    df = spark.createDataFrame([row], "run_id long, duration double, declared double, language_probability double")
    assert N.duration_gate(df).first().problem == f"{column}_not_finite"


def test_scans_over_blocks(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.randrange(100)) for k in (1, 2) for p in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k long, p long, x long").repartition(7)
    got = scans.running_before(
        df, ["k"], "p", {"m": ("max", F.col("x")), "s": ("sum", F.col("x")), "l": ("last", F.col("x"))},
        block=F.floor(F.col("p") / 7)).collect()
    for r in got:
        before = [(p, x) for k, p, x in rows if k == r.k and p < r.p]
        assert r.m == (max(x for _, x in before) if before else None)
        assert r.s == (sum(x for _, x in before) if before else None)
        assert r.l == (max(before)[1] if before else None)
