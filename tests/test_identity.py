"""Records of previews and renders against the run that they lie beside; medians."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cliploom.operators import evaluate, identity

RUN = dict(analysis_fingerprint="a", review_fingerprint="r", decisions_sha256="d",
           transcript_sha256="t", source_sha256="s")
SIZES = dict(width=1080, height=1920, preset="standard", burned=True, rules_version=1)
SCHEMAS = dict(candidates_schema=identity.CANDIDATES_SCHEMA, decisions_schema=identity.DECISIONS_SCHEMA)


def frame(spark, rows):
    columns = list(rows[0])
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], columns)


@pytest.mark.parametrize("rules", [identity.PREVIEW_RULES, identity.RENDER_RULES])
def test_each_rule_is_the_first_problem_of_its_run(spark, rules):
    """Run i breaks rule i and the last rule; the earlier one is told."""
    run, index, config = [], [], []
    for i in range(len(rules) + 1):
        records = {"run": RUN | {"run_id": i}, "index": RUN | SIZES | {"run_id": i},
                   "config": SIZES | SCHEMAS | {"run_id": i}}
        for rule in rules[i:i + 1] + rules[-1:] * (i < len(rules)):
            kind, name = rule.left.split(".")
            old = records[kind][name]
            records[kind][name] = not old if isinstance(old, bool) else old * 2
        run.append(records["run"])
        index.append(records["index"])
        config.append(records["config"])
    found = identity.coherence(
        {"run": frame(spark, run), "index": frame(spark, index), "config": frame(spark, config)}, rules)
    assert {r.run_id: r.problem for r in found.collect()} == {
        **{i: rule.name for i, rule in enumerate(rules)}, len(rules): None}


def test_missing_records_and_entries(spark):
    run = frame(spark, [RUN | {"run_id": i} for i in (1, 2, 3, 4)])
    index = frame(spark, [RUN | SIZES | {"run_id": i} for i in (1, 3, 4, 5)])
    config = frame(spark, [SIZES | SCHEMAS | {"run_id": i} for i in (1, 2, 4, 5)])
    entries = spark.createDataFrame(
        [(1, "b", "extra"), (1, "a", None), (1, "c", "missing"), (2, "a", "extra"), (4, "a", None)],
        "run_id long, rank string, problem string")
    found = identity.coherence({"run": run, "index": index, "config": config},
                               identity.RENDER_RULES, entries)
    assert {r.run_id: r.problem for r in found.collect()} == {
        1: "extra", 2: "missing_index", 3: "missing_config", 4: None, 5: "missing_run"}


def test_nulls_equal_nulls_only(spark):
    index = frame(spark, [RUN | SIZES | {"run_id": 1}]).withColumn(
        "source_sha256", F.lit(None).cast("string"))
    run, config = frame(spark, [RUN | {"run_id": 1}]), frame(spark, [SIZES | SCHEMAS | {"run_id": 1}])
    rules = identity.PREVIEW_RULES
    assert identity.coherence({"run": run, "index": index, "config": config}, rules).first().problem == "source"
    none = run.withColumn("source_sha256", F.lit(None).cast("string"))
    assert identity.coherence({"run": none, "index": index, "config": config}, rules).first().problem is None


def test_medians_are_exact(spark):
    draw = random.Random(3)
    rows = [(k, draw.randrange(40), draw.choice([None, 5, 9])) for k in "abc" for _ in range(draw.randrange(1, 60))]
    rows += [("hot", 7, None)] * 500 + [("one", 3, 4)]
    df = spark.createDataFrame(rows, "key string, x long, y long").repartition(7)
    got = {r.key: (r.median_x, r.median_y) for r in evaluate.medians(df, ["key"], ["x", "y"]).collect()}
    for key, found in got.items():
        for i in (1, 2):
            values = [r[i] for r in rows if r[0] == key and r[i] is not None]
            assert found[i - 1] == (statistics.median(values) if values else None)
    assert len(got) == 5
