"""Mixing, chat formatting, sharding and WARC."""

import zlib

import pytest
from messy import documents, fair_shares, nothing
from pyspark.sql import functions as F

from cliploom.llm import chat, mixing, sharding, warc


def test_targets_as_by_rounds(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 700, "e": 40, "é": 5, None: 80}
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in
           mixing.source_targets(frame, (5, 2, 1), (3, 2), 2).collect()}
    want = fair_shares(sizes, weights, 1.5 * sum(sizes.values()), 2)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_of_messy_documents(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert len(rows) == 12
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents(spark)).collect()))
    assert mixing.mix(nothing(spark)).count() == 0
    repeated = mixing.mixed_rows(documents(spark))
    assert repeated.columns == documents(spark).columns
    assert repeated.count() == sum(r.taken // r.size if r.size else 0 for r in rows) + sum(
        1 for _ in ()) + mixing.mix(documents(spark)).where("size = 0").agg(
        F.sum("copies")).first()[0]


def test_weights_favour_heavy_documents(spark):
    keys = spark.range(4000).select(
        mixing.sampling_key(F.col("id"), F.lit(1.0), "s").alias("light"),
        mixing.sampling_key(F.col("id") + 10**6, F.lit(4.0), "s").alias("heavy"))
    first = keys.agg(F.avg((F.col("heavy") < F.col("light")).cast("int"))).first()[0]
    assert first == pytest.approx(0.8, abs=0.03)


TREE = "conv_id long, node long, parent long, role string, text string, score double, extra int"


def test_reply_tree_paths_and_ranks(spark):
    rows = [(1, 0, None, "user", "q", 0.0, 1), (1, 1, 0, "assistant", "a", 0.9, 1),
            (1, 2, 0, "assistant", "b", 0.1, 1), (1, 3, 1, "user", "c", None, 1),
            (1, 4, 3, "assistant", "d", 0.2, 1), (1, 5, 1, "user", "e", 0.8, 1),
            (2, 0, 7, None, None, None, 1),  # unknown parent: a root
            (3, 0, 1, "user", "x", 1.0, 1), (3, 1, 0, "user", "y", 1.0, 1),  # a cycle
            (None, 1, None, "user", "n", None, 1), (None, 2, 1, "assistant", "m", None, 1)]
    tree = spark.createDataFrame(rows, TREE)
    got = {(r.conv_id, r.leaf, r.node) for r in chat.paths(tree).collect()}
    assert got == {(1, 2, 2), (1, 2, 0), (1, 4, 4), (1, 4, 3), (1, 4, 1), (1, 4, 0), (1, 5, 5),
                   (1, 5, 1), (1, 5, 0), (2, 0, 0), (None, 1, 1), (None, 2, 2), (None, 2, 1)} - {
        (None, 1, 1)}
    made = {(r.conv_id, r.leaf): r.formatted for r in chat.format_trees(tree).collect()}
    assert made == {(1, 5): "<|user|>\nq</s>\n<|assistant|>\na</s>\n<|user|>\ne</s>\n",
                    (2, 0): "<||>\n</s>\n",
                    (None, 2): "<|user|>\nn</s>\n<|assistant|>\nm</s>\n"}
    assert chat.format_trees(tree, top=9).count() == 5
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_long_thread_takes_few_rounds(spark):
    tree = spark.range(300).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("node"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"),
        F.lit("t").alias("text"))
    assert chat.paths(tree).count() == 300


def test_escapes_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\0\\1\\\\2", "<|x|>\n", "|>\n</s>\n", "", "\\", "é<漢|\\3"]
    turns = [(1, i, role, t) for i, (role, t) in enumerate(
        zip(["user", "assistant", "a|>\n<", "assistant", "assistant", "\\1", "assistant"], texts,
            strict=True))]
    said = spark.createDataFrame(turns, "conv long, turn long, role string, text string")
    made = chat.format_trees(chat.thread(said, "conv", "turn"))
    row = made.select(chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt")).first()
    assert [(t.role, t.text) for t in row.turns] == [t[2:] for t in turns]
    assert row.learnt == [t[3] for t in turns if t[2] == "assistant"]


def test_slots_are_even_and_stable():
    names = [f"s{i}" for i in range(20)]
    owner = sharding.fill_slots(names, 2003)
    counts = [owner.count(i) for i in range(20)]
    assert max(counts) - min(counts) <= 1 and min(owner) == 0
    fewer = sharding.fill_slots(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 19)
    assert moved < 0.25 * 2003
    for bad in (["a", "a"], [], [f"x{i}" for i in range(9)]):
        with pytest.raises(ValueError):
            sharding.fill_slots(bad, 7)
    with pytest.raises(ValueError):
        sharding.fill_slots(["a"], 9)


def test_placing_messy_documents(spark, tmp_path):
    placed = sharding.place(documents(spark), ["x", "y"], 101)
    assert sorted(placed.columns) == sorted(documents(spark).columns)
    rows = placed.collect()
    assert len(rows) == 12 and all(r.shard in "xy" for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.place(nothing(spark), ["x"], 101).count() == 0
    sharding.write_shards(placed, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12


PAGES = "page_id long, url string, html string, digest string, payload int"


def test_pages_round_trip(spark, tmp_path):
    big = "<p>x</p>" * (1 << 21)  # 16 MB and more: an empty member follows the record
    rows = [(1, "http://a", "same", "", 1), (2, "http://b\r\nX: y", "same", "", 1),
            (3, None, None, "", 1), (4, "u", "", "", 1), (5, "u", "é\r\n\r\nWARC/1.1", "", 1),
            (None, "u", "same", "", 1), (6, "u", "same", "", 1), (6, "u", "same", "", 1),
            (7, "u", big, "", 1)]
    path = f"{tmp_path}/warc"
    warc.write_archives(warc.plan_records(spark.createDataFrame(rows, PAGES)), path)
    got = warc.read_archives(spark, path).collect()
    kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to)
                   for r in got)
    assert kinds == sorted([
        (1, "revisit", 6), (2, "revisit", 6), (3, "revisit", 4), (4, "response", None),
        (5, "response", None), (-1, "revisit", 6), (6, "response", None), (6, "response", None),
        (7, "response", None)])
    kept = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert kept == {4: "", 5: "é\r\n\r\nWARC/1.1", 6: "same", 7: big}
    assert {r.payload_bytes for r in got if r.refers_to == 6} == {4}
    # every byte of the files is one of consecutive gzip members
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        while data:
            member = zlib.decompressobj(31)
            member.decompress(data)
            assert member.eof
            data = member.unused_data
    warc.write_archives(warc.plan_records(spark.createDataFrame([], PAGES)), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("split", [300, 1000, 4096, 1 << 20])
def test_magic_inside_members(spark, tmp_path, split):
    """Stored (not deflated) payloads full of gzip magics, read in splits of any size."""
    import random

    draw, payloads = random.Random(split), []
    for i in range(60):
        parts = [bytes(draw.randrange(256) for _ in range(draw.randrange(60)))
                 for _ in range(draw.randrange(12))]
        payloads.append((b"\x1f\x8b\x08" + b"\0" * draw.randrange(3)).join([b"", *parts]))
    whole = b"".join(warc.member(warc.record_bytes(i, None, p, "response", None), 0)
                     for i, p in enumerate(payloads))
    (tmp_path / "stored.warc").write_bytes(whole)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes",
                                            "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.page_id: bytes(r.payload) for r in
               warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict(enumerate(payloads))
