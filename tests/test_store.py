"""Stage tables by content, publication of several tables, fingerprints of what changed."""

import uuid

import pytest
from pyspark.sql import functions as F

from cliploom import session
from cliploom.operators import digests, states
from cliploom.plans.lineage import STAGE_INPUTS
from cliploom.session import files_of, shared_folder, stage_table
from cliploom.sources.store import StageStore, publish, published


@pytest.fixture
def root(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def wanted(spark, prints):
    return spark.createDataFrame(list(prints.items()), "run_id long, fingerprint string")


class Counted:
    """Computes two rows a run, and notes for which runs it was asked."""

    def __init__(self):
        self.asked = []

    def __call__(self, runs):
        self.asked.append(sorted(r.run_id for r in runs.collect()))
        return runs.select("run_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))


def test_only_what_is_missing_is_computed(spark, root):
    compute, prints = Counted(), {1: "a", 2: "b", 3: "c"}
    first = StageStore(spark, root).ensure("analysis", wanted(spark, prints), compute)
    assert first.count() == 6 and compute.asked == [[1, 2, 3]]
    # another session finds all of it
    again = StageStore(spark, root).ensure("analysis", wanted(spark, prints), compute)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    assert len(compute.asked) == 1
    # one changed run is computed; its old rows stay, and are not read
    changed = prints | {2: "b2", 4: "d"}
    rows = StageStore(spark, root).ensure("analysis", wanted(spark, changed), compute)
    assert compute.asked[1:] == [[2, 4]]
    assert {(r.run_id, r.fingerprint) for r in rows.collect()} == set(changed.items())
    # back to the old inputs: nothing to do
    back = StageStore(spark, root).ensure("analysis", wanted(spark, prints), compute)
    assert len(compute.asked) == 2 and back.count() == 6
    # another stage starts anew
    StageStore(spark, root).ensure("render", wanted(spark, {1: "a"}), compute)
    assert compute.asked[2:] == [[1]]


def test_runs_without_rows_are_done_too(spark, root):
    calls = []

    def none(runs):
        calls.append(1)
        return runs.select("run_id", F.lit(1).alias("n")).where("false")

    for _ in range(2):
        assert StageStore(spark, root).ensure("s", wanted(spark, {1: "a"}), none).count() == 0
    assert len(calls) == 1
    assert StageStore(spark, root).ensure("s", wanted(spark, {}), none).count() == 0


def test_rows_of_a_killed_job_are_not_read(spark, root):
    compute = Counted()
    StageStore(spark, root).ensure("s", wanted(spark, {1: "a"}), compute)
    # rows of run 2 are written, and the job dies before they are recorded
    spark.createDataFrame([(2, 9, "b")], "run_id long, n int, fingerprint string").write.parquet(
        f"{root}/s/rows/batch=dead")
    with pytest.raises(Exception, match="dies"):
        StageStore(spark, root).ensure("s", wanted(spark, {3: "c"}), lambda runs: runs.select(
            "run_id", F.raise_error(F.lit("dies")).cast("int").alias("n")))
    rows = StageStore(spark, root).ensure("s", wanted(spark, {1: "a", 2: "b", 3: "c"}), compute)
    assert compute.asked == [[1], [2, 3]]
    assert sorted((r.run_id, r.n) for r in rows.collect()) == [(i, n) for i in (1, 2, 3) for n in (1, 2)]


def test_two_sessions_that_made_the_same_rows_count_once(spark, root):
    store = StageStore(spark, root)
    store.ensure("s", wanted(spark, {1: "a"}), Counted())
    for part in ("rows", "done"):
        spark.read.parquet(f"{root}/s/{part}").drop("batch").write.parquet(f"{root}/s/{part}/batch=zz")
    assert store.ensure("s", wanted(spark, {1: "a"}), Counted()).count() == 2


def test_a_version_is_published_whole_or_not_at_all(spark, root):
    def tables(n):
        return {"a": spark.range(n), "b": spark.range(n)}

    assert published(spark, root) == {}
    publish(spark, root, tables(1))
    publish(spark, root, tables(2))
    # the second table fails when the first is written
    broken = {"a": spark.range(3), "b": spark.range(3).select(F.raise_error(F.lit("dies")))}
    with pytest.raises(Exception, match="dies"):
        publish(spark, root, broken)
    assert {name: t.count() for name, t in published(spark, root).items()} == {"a": 2, "b": 2}
    # a problem is seen before anything is written
    before = len(files_of(spark, f"{root}/versions"))
    with pytest.raises(ValueError, match="late rows"):
        publish(spark, root, tables(4), {"late rows": spark.range(1)})
    assert len(files_of(spark, f"{root}/versions")) == before
    publish(spark, root, tables(5), {"late rows": spark.range(0)})
    assert published(spark, root)["b"].count() == 5


def test_stage_tables_follow_inputs_and_code(spark, monkeypatch):
    built, name = [], uuid.uuid4().hex

    def build():
        built.append(1)
        return spark.range(3)

    for inputs in ("x", "x", "y", "x"):
        assert stage_table(spark, name, inputs, build).count() == 3
    assert len(built) == 2
    monkeypatch.setattr(session, "code_version", lambda: "other")
    stage_table(spark, name, "x", build)
    assert len(built) == 3
    # an attempt that dies leaves no table
    with pytest.raises(Exception, match="dies"):
        stage_table(spark, name, "z", lambda: spark.range(1).select(F.raise_error(F.lit("dies"))))
    assert stage_table(spark, name, "z", build).count() == 3


@pytest.mark.parametrize("changed, stages", [
    ("audio", ["transcription", "analysis", "preview", "review", "render"]),
    ("text", ["transcription", "analysis", "preview", "review", "render"]),
    ("chunks", ["analysis", "preview", "review", "render"]),
    ("decisions", ["review", "render"]),
    ("clips", ["render"]),
    ("files", ["render"]),
])
def test_one_change_reaches_exactly_what_is_made_from_it(spark, changed, stages):
    names = sorted({n for own in STAGE_INPUTS.values() for n in own} - set(STAGE_INPUTS))
    inputs = spark.createDataFrame(
        [(run, *[f"{n}{run}" for n in names]) for run in (1, 2)],
        "run_id long, " + ", ".join(f"{n} string" for n in names))
    other = inputs.withColumn(changed, F.when(F.col("run_id") == 2, F.lit("new")).otherwise(F.col(changed)))

    def made(frame):
        return digests.stage_fingerprints(frame, STAGE_INPUTS).withColumns({
            "config_sha256": F.lit("c"), "wanted_config_sha256": F.lit("c"),
            "incoherent": F.lit(False), "schema_version": F.lit(1)})

    verdicts = {(r.run_id, r.stage): r.verdict
                for r in states.reuse_verdicts(made(other), made(inputs)).collect()}
    assert {k for k, v in verdicts.items() if v != "reusable"} == {(2, s) for s in stages}
    own = {s for s in stages if changed in STAGE_INPUTS[s]}
    for stage in stages:
        assert verdicts[2, stage] == ("inputs_differ" if stage in own else "fingerprint_differs")
