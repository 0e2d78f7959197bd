"""Streams over several files: batches merge, and rows past the watermark are late."""

import uuid
from datetime import datetime, timedelta

from cliploom.session import files_of, remove, shared_folder
from cliploom.streaming import reviews

LOG = "run_id long, candidate_id string, ts timestamp, event_id long, decision string"
USAGE = "run_id long, ts timestamp, tokens long"
BEGIN = datetime(2024, 1, 1)


def stream(spark, folder, schema, batches):
    """A stream that takes one file per batch, in the order given."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(f"{folder}/*"))


def at(hours):
    return BEGIN + timedelta(hours=hours)


def test_decisions_of_later_batches_replace_earlier_ones(spark, tmp_path):
    log = stream(spark, str(tmp_path), LOG, [
        [(1, "a", at(1), 1, "approved"), (1, "b", at(1), 2, "approved")],
        [(1, "a", at(3), 3, "rejected"), (2, "a", at(1), 4, "edited")],
        [(1, "a", at(2), 5, "edited"), (1, "b", at(1), 6, "rejected")]])
    got = {(r.run_id, r.candidate_id): r.decision
           for r in reviews.latest_decisions(log).collect()}
    assert got == {(1, "a"): "rejected", (1, "b"): "rejected", (2, "a"): "edited"}


def test_late_usage_is_left_out(spark, tmp_path):
    usage = stream(spark, str(tmp_path), USAGE, [
        [(1, at(1), 10), (1, at(23), 20)],
        [(1, at(30), 5), (1, at(22), 1)],     # the first day is still open
        [(1, at(60), 7)],                     # moves the watermark to hour 58
        [(1, at(2), 1000), (1, at(61), 2)]])  # too late, and on time
    got = {r.window_start.day: (r.calls, r.tokens)
           for r in reviews.usage_windows(usage).collect()}
    assert got == {1: (3, 31), 2: (1, 5), 3: (2, 9)}


def test_many_batches_leave_a_table_as_large_as_its_keys(spark):
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    table = reviews.ChangedTable(spark, folder, ["id"], ["n"], merged=4)
    want = {}
    for number in range(30):
        rows = [(i, 100 * number + i) for i in range(number % 3, 6, 2)]
        want |= dict(rows)
        frame = spark.createDataFrame(rows, "id long, n long")
        table.land(frame, number)
        if number % 7 == 0 or (number + 1) % 4 == 0:
            table.land(frame, number)  # a retry, also of the batch that merged
        assert {r.id: r.n for r in table.read().collect()} == want
    parts = {f.path.split("/batch=")[1].split("/")[0] for f in files_of(spark, folder)}
    assert len(parts) <= 10  # two versions, and the changes since the one before
    versions = [f for f in files_of(spark, f"{folder}/table") if f.path.endswith("_SUCCESS")]
    assert len(versions) == 2
    assert spark.read.parquet(versions[-1].path.removesuffix("/_SUCCESS")).count() == len(want)


def test_a_version_that_died_is_made_again(spark):
    folder = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    table = reviews.ChangedTable(spark, folder, ["id"], ["n"], merged=2)
    one = spark.createDataFrame([(1, 1)], "id long, n long")
    table.land(one, 0)
    # the version of batch 1 was begun, and has no mark
    one.selectExpr("id", "5L AS batch", "99L AS n").write.parquet(f"{folder}/table/batch=1")
    remove(spark, f"{folder}/table/batch=1/_SUCCESS")
    table.land(spark.createDataFrame([(2, 2)], "id long, n long"), 1)
    assert {r.id: r.n for r in table.read().collect()} == {1: 1, 2: 2}


def test_late_usage_is_counted_beside_the_rest(spark, tmp_path):
    batches = [
        [(1, at(1), 10), (1, at(23), 20)],
        [(1, at(30), 5), (1, at(22), 1)],
        [(1, at(60), 7)],
        [(1, at(2), 1000), (2, at(3), 4), (1, at(61), 2)],
        [(1, at(2), 500), (2, at(59), 1)]]
    usage = stream(spark, f"{tmp_path}/a", USAGE, batches)
    counted, late = reviews.usage_with_late(usage)

    def by_day(frame):
        return {(r.run_id, r.window_start.day): (r.calls, r.tokens) for r in frame.collect()}

    assert by_day(counted) == {(1, 1): (3, 31), (1, 2): (1, 5), (1, 3): (2, 9), (2, 3): (1, 1)}
    assert by_day(late) == {(1, 1): (2, 1500), (2, 1): (1, 4)}
    again = stream(spark, f"{tmp_path}/b", USAGE, batches)
    assert by_day(reviews.usage_windows(again)) == by_day(counted)
