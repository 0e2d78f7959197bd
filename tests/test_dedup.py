"""Greedy deduplication: named cases and larger runs against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from cliploom.operators import dedup
from cliploom.operators.dedup import greedy_dedup, overlap_partners

SCHEMA = "run_id long, candidate_id string, start double, end double, total_score double"


def iou(a, b):
    overlap = min(a[1], b[1]) - max(a[0], b[0])
    return 0.0 if overlap <= 0 else overlap / ((a[1] - a[0]) + (b[1] - b[0]) - overlap)


def loop(rows, threshold):
    """rows: (run, id, start, end, score) -> {(run, id): keeper id or None}"""
    out, kept = {}, {}
    for run, name, s, e, score in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        mine = kept.setdefault(run, [])
        keeper = next((k for k, ks, ke in mine if iou((ks, ke), (s, e)) >= threshold - 1e-9), None)
        out[run, name] = keeper
        if keeper is None:
            mine.append((name, s, e))
    return out


def run(spark, rows, threshold, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5, F.rand(random.randrange(99)))
    return {(r.run_id, r.candidate_id): r.kept_id
            for r in greedy_dedup(df, threshold, **more).collect()}


@pytest.mark.parametrize("rows,threshold,dropped", [
    ([(1, "a", 4.0, 64.0, 80.0), (1, "b", 24.0, 84.0, 70.0)], 0.50, {"b": "a"}),
    ([(1, "a", 4.0, 64.0, 80.0), (1, "b", 24.0, 84.0, 70.0)], 0.51, {}),
    ([(1, "a", 0.0, 40.0, 90.0), (1, "b", 5.0, 45.0, 80.0), (1, "c", 30.0, 70.0, 70.0)], 0.6,
     {"b": "a"}),
    ([(1, "a", 10.0, 40.0, 90.0), (1, "b", 10.0, 41.0, 80.0), (1, "c", 10.0, 40.5, 50.0)], 0.6,
     {"b": "a", "c": "a"}),
    ([(1, "a", 10.0, 39.0, 70.0), (1, "b", 10.0, 39.0, 70.0)], 0.6, {"b": "a"}),
    ([(1, "a", 10.0, 40.0, 70.0), (1, "b", 40.0, 70.0, 70.0)], 0.1, {}),
])
def test_named_cases(spark, rows, threshold, dropped):
    got = run(spark, rows, threshold)
    assert {k[1]: v for k, v in got.items() if v} == dropped


@pytest.mark.parametrize("threshold", [0.6, 0.25, 0.95, 1.0, 0.0])
def test_hot_run_equals_loop(spark, threshold):
    rng = random.Random(int(threshold * 100))
    rows = []
    for i in range(400):
        s = round(rng.uniform(0, 300), 2)
        rows.append((7, f"h{i:04d}", s, s + rng.choice([20.0, 30.0, 45.5, 90.0]),
                     float(rng.randrange(65, 75))))
    rows += [(7, f"copy{i:04d}", 50.0, 80.0, 70.0) for i in range(200)]
    rows += [(8, f"s{i}", float(i), i + 30.0, 70.0) for i in range(20)]
    assert run(spark, rows, threshold) == loop(rows, threshold)


@pytest.mark.parametrize("tile, top", [(40.0, 3), (100.0, 16), (100000.0, 5)])
@pytest.mark.parametrize("threshold", [0.6, 0.1])
def test_tiles_equal_the_loop_however_small(spark, monkeypatch, tile, top, threshold):
    """Intervals that reach over several borders, a run of a third of all rows, ties in score."""
    monkeypatch.setattr(dedup.settle, "__defaults__", (tile, top))
    rng = random.Random(int(tile))
    rows = [(r, f"c{r}-{i}", s, s + rng.choice([0.0, 5.0, 25.0, 60.0, 300.0]), float(rng.randrange(60, 70)))
            for r in [1] * 10 + list(range(2, 22)) for i in range(12) for s in [rng.uniform(-50, 600)]]
    rows = [(r, f"{name}-{i}", *rest) for i, (r, name, *rest) in enumerate(rows)]
    assert run(spark, rows, threshold) == loop(rows, threshold)


def test_ranks_follow_the_priority(spark):
    rng = random.Random(8)
    rows = [(i % 3, f"c{i:03d}", s, s + 30.0, float(rng.randrange(60, 64)))
            for i in range(200) for s in [rng.uniform(0, 3000)]]
    got = {(r.run_id, r.candidate_id): r.priority_rank
           for r in greedy_dedup(spark.createDataFrame(rows, SCHEMA), 0.5).collect()}
    kept = {k for k, keeper in loop(rows, 0.5).items() if keeper is None}
    want = {}
    for run_id in range(3):
        own = sorted((r for r in rows if r[0] == run_id and (r[0], r[1]) in kept),
                     key=lambda r: (-r[4], r[2], r[1]))
        want |= {(run_id, r[1]): n for n, r in enumerate(own, 1)}
    assert got == {(r[0], r[1]): want.get((r[0], r[1])) for r in rows}


def test_no_python_runs_in_the_tasks(spark):
    rows = [(1, f"c{i}", float(i), i + 30.0, 70.0) for i in range(50)]
    df = greedy_dedup(spark.createDataFrame(rows, SCHEMA), 0.6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_fold_equals_loop(spark):
    rng = random.Random(3)
    rows = [(r, f"c{i}", s, s + rng.uniform(20, 90), float(rng.randrange(60, 100)))
            for r in range(20) for i in range(30) for s in [rng.uniform(0, 200)]]
    assert run(spark, rows, 0.6) == loop(rows, 0.6)


def test_ineligible_rows_pass_through(spark):
    rows = [(1, "a", 0.0, 30.0, 99.0), (1, "b", 0.0, 30.0, 70.0), (1, "c", 1.0, 31.0, 60.0)]
    got = run(spark, rows, 0.6, eligible=F.col("candidate_id") != "a")
    assert got == {(1, "a"): None, (1, "b"): None, (1, "c"): "b"}


@pytest.mark.parametrize("step", [20.0, 5.0])
def test_falling_scores_along_a_run(spark, step):
    """Nothing conflicts at 20 s; at 5 s each clip conflicts with the next one."""
    rows = [(1, f"c{i:05d}", i * step, i * step + 60.0, 5000.0 - i) for i in range(2000)]
    assert run(spark, rows, 0.6) == loop(rows, 0.6)


def test_copies_are_one_interval(spark):
    df = spark.range(100_000).select(
        F.lit(1).cast("long").alias("run_id"), F.format_string("c%06d", "id").alias("candidate_id"),
        F.lit(10.0).alias("start"), F.lit(40.0).alias("end"), F.lit(70.0).alias("total_score"))
    kept = greedy_dedup(df, 0.6).groupBy("kept_id", "iou").count().collect()
    assert {(r.kept_id, r.iou, r["count"]) for r in kept} == {
        (None, None, 1), ("c000000", 1.0, 99_999)}


def test_thresholds_by_key(spark):
    rows = [(r, f"c{i}", s, s + 30.0, 90.0 - i) for r in (1, 2, 3) for i in range(40)
            for s in [(i * 7) % 50 * 1.0]]
    limits = {1: 0.6, 2: 0.3, 3: 0.9}
    df = spark.createDataFrame(rows, SCHEMA)
    column = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]),
                          F.col("run_id").cast("int"))
    got = {(r.run_id, r.candidate_id): r.kept_id
           for r in greedy_dedup(df, 0.0, threshold_column=column).collect()}
    assert got == {k: v for run_id, limit in limits.items()
                   for k, v in loop([r for r in rows if r[0] == run_id], limit).items()}


def test_partners(spark):
    rng = random.Random(5)
    rows = [(1, f"c{i:03d}", s, s + rng.uniform(1, 120), 1.0)
            for i in range(150) for s in [rng.uniform(0, 400)]]
    rows += [(1, f"copy{i}", 10.0, 40.0, 1.0) for i in range(30)]
    for threshold in (0.1, 0.5, 0.9):
        want = {}
        for a in rows:
            hits = [iou(a[2:4], b[2:4]) for b in rows if b[1] != a[1]]
            hits = [h for h in hits if h >= threshold]
            want[a[1]] = (len(hits), max(hits) if hits else None)
        got = overlap_partners(spark.createDataFrame(rows, SCHEMA), threshold).collect()
        assert {r.candidate_id: (r.partners, r.best_iou) for r in got} == want
