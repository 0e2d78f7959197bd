"""Words, the largest rows there are, must not be shuffled: lines are, before they are taken apart."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cliploom.operators import captions, dedup, digests, proposals
from cliploom.operators.dedup import greedy_dedup
from cliploom.plans import views as plan_views
from cliploom.plans.views import Views
from cliploom.session import files_of, write_stage
from cliploom.sources import documents

FOLDER = "/root/testdata/sf0.001"


def above(frame, node):
    """Names of the nodes above the first ``node`` of a plan, from the nearest on."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    rows = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in lines if x.strip(" :+-")]
    at = next(i for i, (_, text) in enumerate(rows) if text.startswith(node))
    depth, found = rows[at][0], []
    for level, text in reversed(rows[:at]):
        if level < depth:
            depth = level
            found.append(text.split(" ")[0])
    return found


@pytest.fixture
def views(spark):
    """No table counts as small, as at size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    yield Views(spark, FOLDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    spark.conf.set("spark.sql.shuffle.partitions", tasks)


@pytest.mark.parametrize("name", ["words_ms", "raw_words", "clamped_words"])
def test_words_stay_where_their_line_is(views, name):
    frame = getattr(views, name)
    assert "Exchange" not in above(frame, "Generate posexplode(split(line")


def test_ends_go_to_the_words_not_words_to_the_ends(views):
    placed = proposals.place(views.proposals, views.chunks)
    seen = proposals.with_anchors(placed, views.segments, views.words, 2.5, words_inside=True)
    nodes = above(seen, "Generate posexplode(split(line")
    assert any("Aggregate" in n for n in nodes[:nodes.index("Exchange")])


def test_ends_are_dealt_once_to_as_many_tasks_as_words(views):
    views.__dict__["parts"] = 48  # more than joins have, as for a large folder
    placed = proposals.place(views.proposals, views.chunks)
    seen = proposals.with_anchors(
        placed, views.segments, views.word_times, 2.5, words_inside=True, parts=views.parts)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(run_id#\d+L?, (?:seg_)?index#\d+L?, (\d+)\)", plan)
    assert dealt == ["48", "48"]


def test_a_kept_interval_is_looked_up_only_where_a_conflict_may_start(spark):
    kept = spark.createDataFrame(
        [(1, 3000.0, 3060.0, 0.6, 9.0, "a")],
        "run_id long, start double, end double, limit double, total_score double, candidate_id string")
    longest = spark.createDataFrame([(1, 100.0)], "run_id long, longest double")
    slots = [r.slot for r in dedup._beside(kept, longest, ["run_id"]).orderBy("slot").collect()]
    assert slots == [98, 99, 100]  # from 3000 - 0.4 * 100 to 3060 - 0.6 * 60


def test_leaves_in_bytes_give_the_digest_of_leaves_in_hex(views):
    leaves = views.segments_ms.withColumn("hex", digests.segment_digest())
    want = digests.tree_digest(leaves, ["run_id"], "index", "hex", "transcript_sha256")
    got = digests.transcript_digest(views.segments_ms)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "unhex(" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_segment_lies_in_few_stretches(spark):
    segments = spark.createDataFrame([(1, 0, 100.0, 130.0)], "run_id long, index long, start double, end double")
    asked = spark.createDataFrame(
        [(1, 7, 110.0, 131.0, 0.0, 200.0, 2.5), (1, 8, 96.0, 134.0, 0.0, 200.0, 2.5)],
        "run_id long, _id long, start double, end double, window_start double, window_end double, _reach double")
    met = proposals._met(asked, segments, segments.limit(0), 2.5, True)
    assert sorted((r._id, r.opens) for r in met.collect()) == [(7, False), (7, True)]
    assert "bucket" not in met.columns and proposals.STRETCH * proposals.bucket_seconds(2.5) == 60


def test_speech_outside_its_segment_counts(spark):
    segments = spark.createDataFrame([(1, 0, 100.0, 101.0)], "run_id long, index long, start double, end double")
    words = spark.createDataFrame([(1, 0, 30.0, 31.0)], "run_id long, seg_index long, start double, end double")
    placed = spark.createDataFrame(
        [(1, 29.0, 60.0, 0.0, 200.0)],
        "run_id long, start double, end double, window_start double, window_end double")
    row = proposals.with_anchors(placed, segments, words, 2.5).first()
    assert row.start_anchor.at == 30.0 and row.start_grounded and not row.end_grounded


def test_clips_go_to_the_words_not_words_to_the_clips(views):
    tokens = captions.clip_words(views.words, views.targets, views.segments)
    assert "Exchange" not in above(tokens, "Generate posexplode(split(line")


@pytest.mark.parametrize("kind,text", [
    (documents.TRANSCRIPT, "segments"), (documents.BATCHES, "batches"), (documents.DECISIONS, "decisions")])
def test_a_filter_does_not_read_texts_again(spark, kind, text):
    docs = spark.createDataFrame([(1, "{}")], "run_id long, document string")
    rows = documents.rows_of(documents.parse(docs, kind), text)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2  # the content, and whether it is one value


def test_a_list_lacks_what_one_row_lacks(spark):
    shape = {"rows": [{"a": "int", "b?": "number"}]}
    texts = {
        '{"rows":[{"a":1},{"a":2,"b":0.5},{"a":3,"b":null}]}': True, '{"rows":[]}': True,
        '{"rows":[{"a":1},{"b":2}]}': False, '{"rows":[{"a":1},{"a":null}]}': False,
        '{"rows":[{"a":1},null]}': False, '{"rows":null}': False, "{}": False,
        '{"rows":[{"a":1},{"a":1.5}]}': False, '{"rows":[{"a":1},{"a":2,"c":1}]}': False,
        '{"rows":[{"a":1},{"a: BIGINT, b":2,"a":1}]}': False, '{"rows":[[]]}': False}
    read = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.parse_json("t").alias("j"), F.from_json("t", documents.ddl(shape)).alias("doc"))
    for how in (documents.fits("j", shape), documents.fits_whole("j", "doc", shape)):
        assert {r.t: r.ok for r in read.selectExpr("t", f"coalesce({how}, false) AS ok").collect()} == texts


def test_times_of_words_need_no_text(views):
    words, times = views.words.drop("word"), views.word_times
    assert times.exceptAll(words).isEmpty() and words.exceptAll(times).isEmpty()
    assert "join(tokens,  )" not in times._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_are_not_eligible_pass_by(spark):
    rows = spark.createDataFrame(
        [(1, "a", 0.0, 30.0, 9.0, True), (1, "b", 0.0, 30.0, 8.0, True), (1, "c", 0.0, 30.0, 9.5, False),
         (1, "d", 50.0, 80.0, 1.0, None)],
        "run_id long, candidate_id string, start double, end double, total_score double, able boolean")
    found = {stored: greedy_dedup(rows, 0.6, eligible=F.col("able"), stored=stored) for stored in (True, False)}
    assert found[True].columns == found[False].columns
    assert sorted(map(str, found[True].collect())) == sorted(map(str, found[False].collect()))
    assert found[True].where("kept_id = 'a'").count() == 1


def test_a_clip_takes_a_segment_as_one_row(views):
    heard = captions._heard(views.words, views.targets, views.segments)
    together = captions._gathered(heard)
    assert together.exceptAll(heard).isEmpty() and heard.exceptAll(together).isEmpty()
    nodes = above(together, "Generate posexplode(split(line")
    assert any("Aggregate" in n for n in nodes[:nodes.index("Exchange")])


def test_digests_pass_from_level_to_level_in_bytes(spark, monkeypatch):
    kinds, join = [], digests._join_digests

    def seen(level, keys):
        kinds.append(level.schema["_d"].dataType.simpleString())
        return join(level, keys)

    monkeypatch.setattr(digests, "_join_digests", seen)
    rows = spark.range(3000).selectExpr("id % 2 AS run_id", "id AS at", "sha2(string(id), 256) AS leaf")
    leaves = {run: [hashlib.sha256(str(i).encode()).hexdigest() for i in range(run, 3000, 2)] for run in (0, 1)}

    def joined(parts):
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    want = {run: joined([joined([joined([x for i, x in enumerate(found) if (2 * i + run) // 1024 == b])
                                 for b in range(3)])]) for run, found in leaves.items()}
    for leaf in (F.col("leaf"), F.unhex("leaf")):
        kinds.clear()
        assert dict(digests.tree_digest(
            rows.withColumn("leaf", leaf), ["run_id"], "at", "leaf", "d").collect()) == want
        assert kinds[1:] == ["binary", "binary"]


def test_stages_that_are_read_once_are_stored_small(spark):
    rows = spark.range(4000).selectExpr("sha2(string(id), 256) AS d")

    def size(compression):
        kept = write_stage(rows, "small", compression)
        return sum(f.size for f in files_of(spark, kept.inputFiles()[0].rsplit("/", 1)[0]))

    assert size("zstd") < 0.7 * size(None)


def test_proposals_keep_the_extent_of_their_chunk(views):
    want = proposals.place(views.proposals, views.chunks)
    assert sorted(want.columns) == sorted(views.placed.columns)
    assert want.exceptAll(views.placed.select(want.columns)).isEmpty()
    assert want.count() == views.placed.count()


@pytest.mark.parametrize("tile", [captions.TILE, 7.0])
def test_lines_bring_clips_the_words_they_hear(views, monkeypatch, tile):
    monkeypatch.setattr(captions, "TILE", tile)
    got = captions.tokens_of(views.clips_heard).drop("token_pos")
    want = captions.clip_words(views.words, views.targets, views.segments).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert views.clips_heard.count() == views.targets.count()


def test_lines_meet_clips_once_and_no_word_is_shuffled(views):
    frame = captions.group_words(views.clips_heard)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(run_id#\d+L?, tile#\d+L?, \d+\)", plan)
    assert plan.count("Exchange") == len(dealt) == 3  # lines, and clips: to the lines, and by themselves


def test_odd_white_space_in_lines(spark):
    lines = spark.createDataFrame(
        [(1, 0, 0.0, 1.48, "ab \u00a0 c\u2003d ."), (1, 1, 5000.0, 5000.2, "x"), (1, 2, 6000.0, 6000.2, "\t")],
        "run_id long, seg_index long, start double, end double, line string")
    clips = spark.createDataFrame(
        [(1, "a", 0.0, 20.0), (1, "long", 1.0, 6001.0), (1, "silent", 30.0, 40.0), (2, "none", 0.0, 9.0)],
        "run_id long, candidate_id string, start double, end double")
    found = {r.candidate_id: (r.texts, r.places, r.segments) for r in captions.lines_to_clips(
        lines, clips, plan_views._words_near).collect()}
    assert found == {"a": (["ab", "c d", "."], [0, 2, 3], [0, 0, 0]), "long": ([".", "x"], [3, 0], [0, 1]),
                     "silent": ([], [], []), "none": ([], [], [])}


def test_wrap_is_the_best_split(spark):
    rng = random.Random(3)
    rows = [(["x" * rng.randrange(1, 24) for _ in range(rng.randrange(2, 9))],) for _ in range(300)]

    def best(words):
        if len(" ".join(words)) <= 42:
            return [" ".join(words)]
        return min(([" ".join(words[:k]), " ".join(words[k:])] for k in range(1, len(words))),
                   key=lambda two: max(map(len, two)))

    got = spark.createDataFrame(rows, "words array<string>").select("words", captions.wrap_lines(F.col("words")).alias("w"))
    assert all(r.w == best(r.words) for r in got.collect())


def test_what_proposals_say_is_not_stored(views):
    for stored, whole in ((views.placed_stored, views.placed), (views.assessed_stored, views.assessed),
                          (views.outcomes_stored, views.outcomes)):
        assert not set(plan_views.TOLD) & set(stored.columns)
        assert sorted([*stored.columns, *plan_views.TOLD]) == sorted(whole.columns)
