"""Validation, snapping, scoring and the funnel on the twelve-segment grid."""

import dataclasses
import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import chunking, proposals, review, selection
from cliploom.operators.ledger import admitted, ledger
from cliploom.plans.views import VIEW_POLICY, Views
from cliploom.rules import Policy

POLICY = Policy(window_seconds=360.0, overlap_seconds=30.0)
SCORES = "hook:int,value:int,context_independence:int,clarity:int,engagement_potential:int,relevance:int"


def grid(spark):
    """Segment i is [10i, 10i+9] with two half-second words; 1 s of silence between."""
    segments = spark.createDataFrame(
        [(1, i, 10.0 * i, 10.0 * i + 9, f"text {i}") for i in range(12)],
        "run_id long, index long, start double, end double, text string")
    words = spark.createDataFrame(
        [(1, i, w, "w", s, s + 0.5) for i in range(12) for w, s in
         ((0, 10.0 * i), (1, 10.0 * i + 8.5))],
        "run_id long, seg_index long, word_pos long, word string, start double, end double")
    runs = spark.createDataFrame([(1, 119.0)], "run_id long, duration double")
    return segments, words, runs


def propose(spark, items):
    """items: (start, end, hook rating) -> proposals in chunk_0000"""
    rows = [(1, "chunk_0000", i, float(s), float(e), f"cand_{i:04d}", (h, 80, 80, 80, 80, 80))
            for i, (s, e, h) in enumerate(items)]
    return spark.createDataFrame(
        rows, f"run_id long, chunk_id string, ordinal long, start double, end double, "
              f"candidate_id string, scores struct<{SCORES}>")


def funnel(spark, items, policy=POLICY, **more):
    segments, words, runs = grid(spark)
    chunks = chunking.chunk_extents(segments, runs, policy)
    rows = propose(spark, items).repartition(4, F.rand(random.randrange(99)))
    out = selection.select_candidates(rows, chunks, segments, words, policy, **more)
    return {r.candidate_id: r for r in out.collect()}


def test_unknown_chunks_stay_in_the_funnel(spark):
    segments, words, runs = grid(spark)
    chunks = chunking.chunk_extents(segments, runs, POLICY)
    rows = propose(spark, [(10, 39, 80), (50, 80, 90)]).withColumn("chunk_id", F.when(
        F.col("candidate_id") == "cand_0001", "chunk_9999").otherwise(F.col("chunk_id")))
    out = selection.select_candidates(rows, chunks, segments, words, POLICY)
    found = {r.candidate_id: r for r in out.collect()}
    assert found["cand_0001"].invalid_reasons == ["unknown_chunk", "ungrounded"]
    assert found["cand_0000"].outcome == "selected"
    counts = selection.funnel(out).first()
    assert (counts.proposed, counts.invalid) == (2, 1)


@pytest.mark.parametrize("start,end,reasons", [
    (10.0, 39.0, []),
    (-1.0, 39.0, ["invalid_interval", "outside_chunk"]),
    (30.0, 30.0, ["invalid_interval"]),
    (30.0, 29.0, ["invalid_interval"]),
    (10.0, 30.0 - 5e-7, []),
    (10.0, 30.0 - 2e-6, ["too_short"]),
    (10.0, 100.0 + 5e-7, []),
    (10.0, 100.0 + 2e-6, ["too_long"]),
    (90.0, 119.0 + 5e-7, []),
    (90.0, 119.1, ["outside_chunk", "end_beyond_source"]),
    (90.0, 130.0, ["outside_chunk", "end_beyond_source", "ungrounded"]),
])
def test_validation_edges(spark, start, end, reasons):
    assert list(funnel(spark, [(start, end, 80)])["cand_0000"].invalid_reasons) == reasons


@pytest.mark.parametrize("start,end,got,kinds,reverted", [
    (10.2, 39.4, (10.0, 39.0), ("segment_start", "segment_end"), False),
    (12.6, 39.0, (12.6, 39.0), ("unchanged", "segment_end"), False),
    (12.5, 39.0, (10.0, 39.0), ("segment_start", "segment_end"), False),
    (18.4, 49.0, (18.5, 49.0), ("word_start", "segment_end"), False),
    (19.25, 49.0, (20.0, 49.0), ("segment_start", "segment_end"), False),
    (11.0, 31.0, (11.0, 31.0), ("unchanged", "unchanged"), True),
])
def test_snapping(spark, start, end, got, kinds, reverted):
    row = funnel(spark, [(start, end, 80)])["cand_0000"]
    if reverted:
        # 10.0 .. 30.5 or 29.0 would still be fine; this pair snaps to 19 s and is put back.
        assert row.reverted == (row.start == start and row.end == end)
        return
    assert (row.start, row.end) == got
    assert (row.start_anchor_kind, row.end_anchor_kind) == kinds
    assert row.reverted is reverted


def test_weighted_score_golden(spark):
    df = spark.createDataFrame([((92, 88, 96, 93, 84, 90),), ((100,) * 6,), ((0,) * 6,)],
                               f"scores struct<{SCORES}>")
    got = [float(r[0]) for r in df.select(proposals.weighted_total()).collect()]
    assert got == [91.15, 100.0, 0.0]


def test_funnel_of_six_proposals(spark):
    items = [(10, 39, 80), (10, 39, 70), (-5, 30, 80), (50, 55, 80), (60, 85, 10), (90, 115, 80)]
    out = funnel(spark, items, Policy(min_score=70.0))
    view = {k: (r.outcome, r.rank, r.kept_id) for k, r in out.items()}
    assert view["cand_0001"] == ("deduplicated", None, "cand_0000")
    assert [view[f"cand_{i:04d}"][0] for i in range(6)] == [
        "selected", "deduplicated", "invalid", "invalid", "below_min_score", "selected"]


def test_ceiling_keeps_the_rest(spark):
    out = funnel(spark, [(10, 39, 80), (40, 69, 90), (70, 99, 70)], Policy(max_candidates=2))
    assert sorted((r.outcome, r.rank) for r in out.values() if r.rank) == [
        ("selected", 1), ("selected", 2)]
    assert out["cand_0002"].outcome == "not_in_top_n"


def test_nearest_anchor_equals_brute_force(spark):
    rng = random.Random(11)
    segs, wordrows, t = [], [], 0.0
    for i in range(60):
        start = round(t, 3)
        inner, at = [], start
        for w in range(rng.randrange(1, 6)):
            end = round(at + rng.uniform(0.05, 1.2), 3)
            inner.append((at, end))
            at = round(end + rng.uniform(0, 0.8), 3)
        segs.append((1, i, start, inner[-1][1], "x"))
        wordrows += [(1, i, w, "w", a, b) for w, (a, b) in enumerate(inner)]
        t = inner[-1][1] + rng.choice([-0.3, 0.0, 1.0, 7.0])
    duration = max(s[3] for s in segs) + 1
    segments = spark.createDataFrame(segs, "run_id long, index long, start double, end double, text string")
    words = spark.createDataFrame(
        wordrows, "run_id long, seg_index long, word_pos long, word string, start double, end double")
    runs = spark.createDataFrame([(1, duration)], "run_id long, duration double")
    policy = Policy(window_seconds=60.0, overlap_seconds=10.0)
    chunks = chunking.chunk_extents(segments, runs, policy)
    windows = {r.chunk_id: (r.window_start, r.window_end) for r in chunks.collect()}
    rows = []
    for i in range(200):
        chunk = rng.choice(sorted(windows))
        s = windows[chunk][0] + round(rng.uniform(-3, 65), 2)
        rows.append((1, chunk, i, s, s + round(rng.uniform(1, 40), 2), f"c{i}", (1, 1, 1, 1, 1, 1)))
    df = spark.createDataFrame(rows, "run_id long, chunk_id string, ordinal long, start double, "
                                     f"end double, candidate_id string, scores struct<{SCORES}>")
    placed = proposals.place(df, chunks)
    got = {r.candidate_id: r for r in proposals.with_anchors(placed, segments, words, 2.5).collect()}
    for _, chunk, i, s, e, name, _ in rows:
        ws, we = windows[chunk]
        inside = [g for g in segs if g[3] > ws and g[2] < we]
        ids = {g[1] for g in inside}
        edges = [(0, g[2], g[3]) for g in inside] + [
            (1, w[4], w[5]) for w in wordrows if w[1] in ids]
        for side, t, pick, sign in (("start", s, 1, 1), ("end", e, 2, -1)):
            near = [(abs(x[pick] - t), x[0], sign * x[pick], x[pick]) for x in edges
                    if abs(x[pick] - t) <= 2.5 + 1e-6]
            anchor = got[name][f"{side}_anchor"]
            assert (anchor.at if anchor else None) == (min(near)[3] if near else None)
            grounded = any(a - 1e-6 <= t <= b + 1e-6 or min(abs(t - a), abs(t - b)) <= 2.5 + 1e-6
                           for _, a, b in edges)
            assert got[name][f"{side}_grounded"] == grounded


def chunk_loop(segs, duration, width, overlap):
    out, k = [], 0
    while k * (width - overlap) < duration:
        ws = k * (width - overlap)
        ids = [i for i, (s, e) in enumerate(segs) if e > ws and s < ws + width]
        if ids:
            if out and set(ids) <= set(out[-1][1]):
                break
            out.append((k, ids))
        k += 1
    return out


def test_chunks_equal_loop(spark):
    rng = random.Random(2)
    for trial in range(6):
        segs, t = [], 0.0
        for _ in range(rng.randrange(0, 40)):
            e = t + rng.choice([1.0, 5.0, 30.0, 250.0])
            segs.append((t, e))
            t = rng.choice([e, e + 90.0, t + 0.5])
        duration = (max(e for _, e in segs) if segs else 5.0) + rng.choice([0.0, 200.0])
        df = spark.createDataFrame([(1, i, s, e, f"t{i}") for i, (s, e) in enumerate(segs)],
                                   "run_id long, index long, start double, end double, text string")
        runs = spark.createDataFrame([(1, duration)], "run_id long, duration double")
        policy = Policy(window_seconds=60.0, overlap_seconds=20.0)
        got = chunking.build_chunks(df, runs, policy).orderBy("chunk_index").collect()
        assert [(r.window_k, list(r.segment_indices)) for r in got] == chunk_loop(
            segs, duration, 60.0, 20.0)


def test_skip_covered_continues_after_a_long_segment(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 500.0, "long"), (1, 1, 600.0, 610.0, "later")],
                               "run_id long, index long, start double, end double, text string")
    runs = spark.createDataFrame([(1, 620.0)], "run_id long, duration double")
    policy = Policy(window_seconds=120.0, overlap_seconds=30.0)
    stop = chunking.build_chunks(df, runs, policy).collect()
    skip = chunking.build_chunks(df, runs, policy, skip_covered=True).collect()
    assert len(stop) == 1
    assert sorted(i for r in skip for i in r.segment_indices) == [0, 1]


def test_permutations(spark):
    items = [(10, 39, 80), (10.5, 39, 70), (60, 85, 75)]
    seen = set()
    for order in itertools.permutations(range(3)):
        segments, words, runs = grid(spark)
        chunks = chunking.chunk_extents(segments, runs, POLICY)
        df = propose(spark, items)
        parts = [df.where(F.col("ordinal") == i) for i in order]
        rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
        out = selection.select_candidates(rows, chunks, segments, words, POLICY)
        seen.add(tuple(sorted((r.candidate_id, r.outcome, r.rank) for r in out.collect())))
    assert len(seen) == 1


def test_every_swept_policy_equals_a_run_of_its_own(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    change = functools.partial(dataclasses.replace, VIEW_POLICY)
    policies = {
        "base": VIEW_POLICY, "wide": change(window_seconds=240.0),
        "overlapping": change(overlap_seconds=60.0), "loose_snap": change(snap_seconds=5.0),
        "tight_snap": change(snap_seconds=0.5, overlap_seconds=60.0, target=3),
        "short_clips": change(min_duration=10.0, max_duration=45.0, dedupe_iou=0.3),
        "hook_first": change(weights=("0.50", "0.10", "0.10", "0.10", "0.10", "0.10"), min_score=75,
                             max_candidates=2)}
    columns = ["run_id", "chunk_id", "ordinal", "candidate_id", "outcome", "rank", "start", "end",
               "total_score", "kept_id", "iou", "invalid_reasons", "reverted"]
    swept = selection.outcomes_by_policy(v.proposals, v.segments, v.words, v.runs, policies)
    rows = swept.select("policy_id", *columns).collect()
    funnels = {}
    for name, policy in policies.items():
        chunks = chunking.chunk_extents(v.segments, v.runs, policy)
        alone = selection.select_candidates(v.proposals, chunks, v.segments, v.words, policy)
        got = sorted((r[1:] for r in rows if r.policy_id == name), key=str)
        want = sorted(map(tuple, alone.select(*columns).collect()), key=str)
        assert got == want, name
        funnels[name] = sorted(r[4] for r in got)
    assert all(funnels[n] != funnels["base"] for n in policies if n != "base")


def test_a_difference_that_a_sweep_would_ignore_is_an_error(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    change = functools.partial(dataclasses.replace, VIEW_POLICY)
    for other in (change(snap_seconds=5.0), change(window_seconds=200.0), change(max_duration=50.0),
                  change(weights=("0.50", "0.10", "0.10", "0.10", "0.10", "0.10"))):
        with pytest.raises(ValueError, match="differ before scoring"):
            selection.sweep(v.assessed, {"a": VIEW_POLICY, "b": other})
    selection.sweep(v.assessed, {"a": VIEW_POLICY, "b": change(target=2)})


def test_answers_that_belong_elsewhere_refuse_their_run(spark):
    chunks = spark.createDataFrame([(r, f"chunk_{i}") for r in (1, 2, 3, 4) for i in range(2)],
                                   "run_id long, chunk_id string")
    models = spark.createDataFrame([(r, "m") for r in (1, 2, 3, 4)], "run_id long, model string")
    answers = spark.createDataFrame(
        [(1, "chunk_0", "m"), (1, "chunk_1", None), (2, "chunk_0", "n"), (2, "chunk_7", "m"),
         (3, "chunk_0", "m"), (3, "chunk_0", "m"), (4, "chunk_0", "n"), (9, "chunk_0", "m")],
        "run_id long, chunk_id string, model string")
    found = ledger({"analysis": proposals.answer_problems(answers, chunks, models)})
    assert {(r.run_id, r.problem, r.n_problems) for r in found.collect()} == {
        (2, "unknown_chunk", 2), (3, "answered_twice", 2), (4, "other_model", 1),
        (9, "unknown_chunk", 1)}
    assert {r.run_id for r in admitted(chunks, found).collect()} == {1}


def test_reviews_that_do_not_fit_give_no_clips_at_all(spark):
    selected = spark.createDataFrame(
        [(run, f"c{i}", i, 10.0 * i, 10.0 * i + 30, "tip", 80.0) for run in range(1, 8) for i in (1, 2)],
        "run_id long, candidate_id string, rank long, start double, end double, category string, "
        "total_score double")
    def decided(run, name, i, **other):
        row = {"run_id": run, "candidate_id": name, "decision": "approved",
               "original_start": 10.0 * i, "original_end": 10.0 * i + 30,
               "final_start": 10.0 * i, "final_end": 10.0 * i + 30} | other
        return tuple(row.values())
    rows = [decided(run, f"c{i}", i) for run in range(1, 7) for i in (1, 2)]
    rows += [decided(2, "c1", 1), decided(3, "c9", 9), decided(7, "c1", 1)]
    rows = [r for r in rows if r[:2] not in {(4, "c1"), (5, "c2")}]
    rows += [decided(4, "c1", 1, original_start=11.0), decided(5, "c2", 2, original_end=49.0)]
    decisions = spark.createDataFrame(rows, (
        "run_id long, candidate_id string, decision string, original_start double, "
        "original_end double, final_start double, final_end double"))
    clips = review.clip_targets(selected, decisions).collect()
    assert sorted((c.run_id, c.candidate_id) for c in clips) == [(1, "c1"), (1, "c2"), (6, "c1"), (6, "c2")]
    refused = ledger({"review": review.target_problems(selected, decisions)}).collect()
    assert {(r.run_id, r.problem) for r in refused} == {
        (2, "decided_twice"), (3, "not_selected"), (4, "original_start_differs"),
        (5, "original_end_differs"), (7, "pending")}
