"""Encoding, spelling variants and ranked search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from messy import PROSE, documents, nothing
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cliploom.llm import bpe, lexicon, queries_lexical, ranking, spelling

SMALL = "/root/testdata/sf0.001"
HARD = ["hi<|endoftext|> x  y", "", "a" * 3000, "abcdefgh" * 500, "\n\n  x\t y ", "it's I'LL we've",
        "é漢字 \u0558\u088f x", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "a\u2028b\x85c\x1cd",
        "<|endoftext|", "\U000209d7 \ufffd 1²٣", "  ", " lead", "tail  "]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


def library_ids(library, texts):
    found = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(x.ids, "<u4").tobytes() for x in found]


def random_words(draw, n):
    return sorted({bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 8))) for _ in range(n)})


def test_lexicon_gives_the_ids_of_its_words_and_no_others(tmp_path):
    words = random_words(random.Random(1), 300)
    ids = {w: [i, *range(i % 4)] for i, w in enumerate(words)}
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon((w, np.array(i, "<u4").tobytes()) for w, i in ids.items()))
    made = lexicon.Lexicon(str(tmp_path / "lexicon"))
    asked = [*random_words(random.Random(2), 900), b"", b"abcabcabcabc", b"x", *words]
    for word, number in zip(asked, made.numbers(asked).tolist(), strict=True):
        assert (number >= 0) == (word in ids)
        if number >= 0:
            assert made.ids(number).tolist() == ids[word]


def test_lexicon_is_the_smallest_automaton(tmp_path):
    words = random_words(random.Random(3), 200)
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon((w, b"\0" * 4) for w in words))
    # as many states as there are different sets of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert lexicon.Lexicon(str(tmp_path / "lexicon")).head["states"] == len(endings)


def test_a_lexicon_without_words(tmp_path):
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon([]))
    assert lexicon.Lexicon(str(tmp_path / "lexicon")).numbers([b"a", b""]).tolist() == [-1, -1]


def test_short_and_long_words_merge_alike(vocabulary):
    draw = random.Random(4)
    for size in (1, 2, 7, 40, 90):
        word = bytes(draw.choice(b"etaoin shr") for _ in range(size))
        ids = [vocabulary.first[b] for b in word]
        assert vocabulary.merge(word) == vocabulary._merge_long(ids)


def test_words_merge_side_by_side_as_one_by_one(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "MERGED", 300)
    draw = random.Random(5)
    words = [bytes(draw.choice("etaoin shré".encode()) for _ in range(draw.randrange(1, 130))) for _ in range(800)]
    ids, sizes = vocabulary.merge_all([*words, *words[:9]])
    ends = np.cumsum([0, *sizes])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
        vocabulary.merge(w) for w in [*words, *words[:9]]]


def test_words_are_merged_once_for_many_lookups(vocabulary, library, monkeypatch, tmp_path):
    merged, real = [], bpe.Vocabulary.merge_all
    monkeypatch.setattr(bpe, "LOOKED_UP", 4)
    monkeypatch.setattr(bpe.Vocabulary, "merge_all", lambda v, words: merged.extend(words) or real(v, words))
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon([]))
    made, texts = bpe.Encoder(vocabulary, str(tmp_path / "lexicon")), [*HARD, PROSE, PROSE, *HARD]
    assert [x for t in texts for x in made.encode(iter([t]))] == library_ids(library, texts)
    assert len(merged) == len(set(merged))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)  # forgets after every look-up, same ids
    assert list(made.encode(iter(texts))) == library_ids(library, texts)


@pytest.mark.parametrize("kept", [0, 5, 1000])
def test_encoding_is_the_librarys_whatever_the_lexicon_holds(spark, library, kept):
    texts = [*HARD, None, PROSE, *["".join(random.Random(i).choices("ab 'séß1\n\t!", k=60))
                                   for i in range(200)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = dict(bpe.encode(docs, most=kept).collect())
    want = library_ids(library, texts)
    assert [bytes(found[i]) for i in range(len(texts))] == want


def test_parts_of_long_texts_join(vocabulary, library, monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "PART", 50)
    monkeypatch.setattr(bpe, "LOOKED_UP", 20)
    (tmp_path / "lexicon").write_bytes(lexicon.compile_lexicon([]))
    texts = [PROSE, *HARD, "x  y\n z " * 40, PROSE + "  " + PROSE]
    made = bpe.Encoder(vocabulary, str(tmp_path / "lexicon"))
    assert list(made.encode(iter(texts))) == library_ids(library, texts)


def test_every_sign_is_cut_as_the_library_cuts_it(vocabulary, library):
    """One sign of every late range, its neighbours, and a spread over all code points."""
    edges = {ord(c) + d for c in vocabulary.late for d in (-1, 0, 1)}
    asked = sorted(edges | set(range(0x110000))) [::37]
    cutter = bpe.Cutter(vocabulary)
    for code in asked:
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            text = f"a{chr(code)}1{chr(code)} {chr(code)}{chr(code)}!"
            words = [w for part in cutter.parts(text) for w in part]
            spans = library.pre_tokenizer.pre_tokenize_str(text)
            assert words == [text[a:b] for _, (a, b) in spans], hex(code)


def test_encoding_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in queries_lexical.op11_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc, ids in zip(docs, library_ids(library, [d.text for d in docs]), strict=True):
        decoded = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert tuple(rows[doc.doc_id]) == (
            doc.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_texts_are_encoded_and_decoded_by_one_python_worker(spark):
    plan = queries_lexical.op11_bpe(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_decoding_beside_encoding(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*HARD, None])], "doc_id long, text string")
    found = bpe.encode(docs, decoded=True).withColumn("again", bpe.decoder()("ids")).collect()
    assert len(found) == len(HARD) + 1
    for row in found:
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert row.decoded == row.again == library.decode(ids, skip_special_tokens=False)


def test_encoding_of_messy_tables(spark):
    made = bpe.encode(documents(spark)).withColumn("back", bpe.decoder()("ids"))
    want = documents(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("back"))
    assert sorted(made.select("doc_id", "back").collect(), key=str) == sorted(
        want.collect(), key=str)
    assert bpe.encode(nothing(spark)).collect() == []
    dotted = documents(spark).withColumnRenamed("doc_id", "a.b")
    assert bpe.encode(dotted, "a.b").columns == ["a.b", "ids"]


def test_decoding_of_broken_ids(spark):
    broken = spark.createDataFrame(
        [(bytearray(np.array(ids, "<u4").tobytes()),) for ids in ([50256, 99999], [164], [])]
        + [(None,)], "ids binary")
    assert [r[0] for r in broken.select(bpe.decoder()("ids")).collect()] == [
        "<|endoftext|>", "�", "", None]


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_variants(counts):
    rows = {}
    for word, n in counts.items():
        near = sorted((-counts[o], o) for o in counts if one_apart(word, o))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        rows[word] = (form, len(near))
    out = {}
    for word, (form, n_near) in rows.items():
        root = word
        while rows[root][0] is not None:
            root = rows[root][0]
        out[word] = (form, root, counts[word], n_near, None if form is None else counts[form])
    return out


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n > 1}


def by_word(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_of_random_words_against_all_pairs(spark):
    draw = random.Random(7)
    counts = {}
    for _ in range(250):
        word = "".join(draw.choices("abé", k=draw.randrange(7, 10)))
        counts[word] = draw.choice([2, 3, 25, 40, 300, 4000])
        at = draw.randrange(len(word))
        for other in (word[:at] + word[at + 1:], word[:at] + "c" + word[at:], word[:at] + "ÿ" + word[at + 1:]):
            if len(other) >= 7:
                counts.setdefault(other, draw.choice([2, 21, 250]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert by_word(spelling.variants(words)) == plain_variants(counts)


def test_words_with_hundreds_of_variants(spark):
    """A group of words that are all one letter apart, and of one frequency."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    counts = {f"spellin{a}{b}": 2 for a in letters for b in letters} | {"spelling": 2000}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert by_word(spelling.variants(words)) == plain_variants(counts)


def test_chains_lead_to_their_root(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20000,
              "aabbbbb": 200000}
    found = by_word(spelling.variants(
        spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in found.values()} == {"aabbbbb"}


def test_spelling_query_against_all_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", "text").collect()]
    counts = plain_words(docs)
    found = by_word(queries_lexical.op12_spelling(spark, SMALL))
    assert {w: r[2] for w, r in found.items()} == counts
    some = sorted(counts)[::40]
    for word in some:
        assert found[word][3] == sum(one_apart(word, o) for o in counts)


def test_spelling_of_messy_tables(spark):
    twice = documents(spark).unionAll(documents(spark))
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    rows += [(1, "naïveté NAïVETÉ naïveté " * 9), (None, "spelling spelling speling")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_word(spelling.group_spellings(docs)) == plain_variants(plain_words(rows))
    assert spelling.group_spellings(nothing(spark)).collect() == []
    assert spelling.group_spellings(twice.withColumnRenamed("doc_id", "a.b"), "a.b").columns == [
        "word", "n", "n_near", "form", "form_n", "root"]


def plain_ranking(docs, items, top=20):
    def terms(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, total = sum(map(bool, sizes)), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    rows = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for (doc, c), size in zip(counted, sizes, strict=True):
            m = 75 + 25 * size * n // total if total else 0
            score = sum(k * weight[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(rows, key=str)


def ranked(spark, docs, items, **how):
    index = ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranking.search(index, asked, **how).collect()), key=str)


def random_texts(draw, n, longest):
    words = [f"w{i}" for i in range(25)] + ["Éé", "ÉÉ", "漢字", "a-b", "_"]
    return [" ".join(draw.choices(words, weights=range(len(words), 0, -1), k=draw.randrange(longest)))
            for _ in range(n)]


@pytest.mark.parametrize("shard, block", [(1 << 13, 100_000), (7, 30)])
def test_ranking_of_random_texts(spark, monkeypatch, shard, block):
    draw = random.Random(11)
    docs = list(enumerate(random_texts(draw, 150, 40)))
    docs += [(3, docs[5][1]), (None, docs[5][1]), (None, None), (900, docs[5][1]), (901, "")]
    items = list(enumerate(random_texts(draw, 30, 15)))
    items += [(2, items[4][1]), (None, items[4][1]), (50, None), (51, "unknown words"), (4, items[4][1])]
    monkeypatch.setattr(ranking, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", block)
    assert ranked(spark, docs, items) == plain_ranking(docs, items)
    assert ranked(spark, docs, items, top=3) == plain_ranking(docs, items, 3)


@pytest.mark.parametrize("mined", [0, 3, 256])
def test_sums_of_the_graph_are_those_of_the_items(monkeypatch, mined):
    monkeypatch.setattr(ranking, "MINED", mined)
    draw = random.Random(12)
    items = [Counter(draw.choices("abcdefghij", k=draw.randrange(12))) for _ in range(60)]
    graph = ranking.mine(items)
    part = {t: (np.array([i % 4]), np.array([10 ** (i % 7)])) for i, t in enumerate("abcdefghij")}
    for terms, found in zip(items, ranking._accumulators(graph, part.__getitem__, 4), strict=True):
        wanted = np.zeros(4, np.int64)
        for t, times in terms.items():
            wanted[part[t][0]] += times * part[t][1]
        assert found.tolist() == wanted.tolist()


def test_shared_sums_are_made_once():
    """Three items of two shared halves: each half is made once, and so is what two share."""
    items = [Counter("abcdef"), Counter("abcxyz"), Counter("abcdef"), Counter("defxyz")]
    graph = ranking.mine(items)
    assert sorted(sorted(t for t, _ in leaf) for leaf in graph.leaves.values()) == [
        ["a", "b", "c"], ["d", "e", "f"], ["x", "y", "z"]]
    assert len(graph.sums) == 1 and graph.items[0] == graph.items[2] and len(graph.items[0]) == 1
    asked = Counter()
    list(ranking._accumulators(graph, lambda t: asked.update(t) or ([0], [1]), 1))
    assert set(asked.values()) == {1}


def test_ranking_of_messy_tables(spark):
    index = ranking.build_index(documents(spark))
    asked = documents(spark).withColumn("item_id", F.col("doc_id"))
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(map(tuple, ranking.search(index, asked).collect()), key=str) == plain_ranking(
        rows, rows)
    empty = nothing(spark).withColumn("item_id", F.col("doc_id"))
    assert ranking.search(index, empty).collect() == []
    assert ranking.search(ranking.build_index(nothing(spark)), asked).collect() == []
