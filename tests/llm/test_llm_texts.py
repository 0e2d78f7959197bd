"""Quality rules, toxicity, near duplicates, decontamination, line deduplication, token counts."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from messy import PROSE, documents, fair_shares, nothing
from pyspark.sql import functions as F

import corpus_pipeline
from cliploom.llm import (
    decontam, linededup, mixing, quality, queries_text, sharding, simhash, textstats, tokens,
    toxicity,
)
from cliploom.llm.queries_tables import SHARDS, SLOTS

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    """The first five counts, word by word."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            repeated, len(inside))


@pytest.mark.parametrize("text", [
    None, "", " \n", "a a a a", "a b c d", "a b c x a b c", "é漢 字 x y\x1fz\x85 #*|<>&%$",
    "l one\n\nl one\n \n \nl one", "x\x0by\x0cz\rq\tw"])
def test_counts_as_word_by_word(text):
    assert textstats.text_stats(text)[:5] == plain_stats(text)


def test_counts_of_random_texts():
    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice(["a ", "b ", "c\n", "é ", "# ", "\t"])
                       for _ in range(draw.randrange(80)))
        assert textstats.text_stats(text)[:5] == plain_stats(text)


def test_estimate_is_the_smallest_determinant(spark):
    """Few rows, so that all subsets can be tried."""
    rules = quality.Rules(min_rows=5, share=0.75)
    draw = np.random.default_rng(3)
    inner = draw.normal(0, 0.2, (9, quality.P)) + 1
    rows = np.vstack([inner, inner[:3] + 3])
    frame = spark.createDataFrame(
        [("en", "a", 100, 0, *map(float, r)) for r in rows],
        "lang string, source string, n_words long, n_repeat_words long, "
        + ", ".join(f"{n} double" for n in quality.NAMES))
    model = quality.fit(frame, rules).estimates.first()
    ridge = np.diag(np.square(rules.slack))
    best = min(itertools.combinations(range(12), 9), key=lambda s: np.linalg.det(
        np.cov(rows[list(s)].T, bias=True) + ridge))
    assert set(best) == set(range(9))
    white = np.zeros((quality.P, quality.P))
    white[np.tril_indices(quality.P)] = model.white
    cov = np.cov(inner.T, bias=True) + ridge
    assert np.allclose(model.mean, inner.mean(axis=0))
    assert np.allclose(np.linalg.inv(white.T @ white), cov)


def test_quality_rejects_symbols_and_keeps_prose(spark):
    draw = random.Random(1)
    def prose(n):
        return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9)))
                        for _ in range(n))
    good = [(i, prose(60 + i % 200), "en", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(w + "#$" for w in prose(100).split()), "en", "a") for i in range(20)]
    few = [(2000, prose(90), "fr", "z"), (2001, prose(10), "fr", "z")]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {g[0] for g in good} | {2000}


def plain_vector(text):
    counts = dict(zip(textstats.FIELDS, textstats.text_stats(text), strict=True))

    def share(part, whole):
        return math.asin(math.sqrt(min(1.0, counts[part] / max(1, counts[whole]))))

    return [math.log(max(1, counts["word_chars"]) / max(1, counts["n_words"])),
            share("n_symbols", "word_chars"), share("n_marks", "word_chars"),
            share("n_upper", "word_chars"), share("n_digits", "word_chars"),
            share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")]


def plain_distances(rows, rules):
    """Squared distances of (lang, source, vector) rows, by concentration from many random starts
    on sorted distances."""
    pairs = Counter((lang, source) for lang, source, _ in rows)
    pooled = Counter()
    for (lang, _), n in pairs.items():
        pooled[lang] += n if n < rules.min_rows else 0

    def stratum(lang, source):
        if pairs[lang, source] >= rules.min_rows:
            return lang, source
        return (lang,) if pooled[lang] >= rules.min_rows else ()

    named = [stratum(lang, source) for lang, source, _ in rows]
    ridge = np.diag(np.square(rules.slack))
    out = np.zeros(len(rows))
    for name in set(named):
        at = [i for i, own in enumerate(named) if own == name]
        x = np.array([rows[i][2] for i in at])
        size = math.ceil(rules.share * len(x))
        best = None
        draw = np.random.default_rng(1)
        for _ in range(40):
            inner = draw.choice(len(x), min(len(x), 2 * quality.P), replace=False)
            for _ in range(30):
                mean, cov = x[inner].mean(axis=0), np.cov(x[inner].T, bias=True).reshape(
                    quality.P, quality.P) + ridge
                square = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                inner = np.argsort(square, kind="stable")[:size]
            found = (np.linalg.slogdet(cov)[1], square)
            best = min(best, found, key=lambda f: f[0]) if best else found
        out[at] = best[1] / max(1.0, np.median(best[1]) / quality.MEDIAN)
    return out


def assert_verdicts(rows, kept, rules=quality.Rules()):
    """rows: (lang, source, text) that do not fail outright. Verdicts agree wherever the distance
    is not within a third of the limit; estimates from binned distances differ by that little."""
    found = plain_distances([(lang, source, plain_vector(t)) for lang, source, t in rows], rules)
    far, near = found > quality.limit(rules) * 1.5, found < quality.limit(rules) / 1.5
    kept = np.array(kept)
    assert not kept[far].any() and kept[near].all()
    assert far.sum() + near.sum() >= 0.95 * len(rows)


def test_each_statistic_rejects_alone(spark):
    draw = random.Random(9)

    def word():
        return "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(3, 9)))

    def lines(n):
        return [" ".join(word() for _ in range(6)) for _ in range(n)]

    clean = ["\n".join(lines(draw.randrange(12, 40))) for _ in range(600)]
    own = lines(3)
    bad = {
        # short lines often, so that windows of three words repeat in few of the words
        "repeated_lines": "\n".join([x for long in lines(30) for x in (long, "ab")]),
        "repeats": "\n".join([*lines(10), *own, *own, *own[:1]]) + " " + own[2],
        "digits": "\n".join(" ".join(w if i % 2 else str(draw.randrange(10**5, 10**6))
                                     for i, w in enumerate(x.split())) for x in lines(20)),
        "symbols": "\n".join(x + " ## $$ && %%" for x in lines(20)),
        "marks": "\n".join(x.replace(" ", ", ") + "..." for x in lines(20)),
        "upper": "\n".join(x.title() for x in lines(20)),
        "word_length": "\n".join(" ".join(w * 4 for w in x.split()) for x in lines(20)),
    }
    assert set(bad) == set(quality.NAMES)
    texts = [*clean, *bad.values()]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string")
    measured = quality.measure(docs, "doc_id")
    verdict = {r.keep_doc_id: r for r in quality.judge(measured, quality.fit(measured)).collect()}
    assert not any(verdict[i].base_failed for i in range(len(texts)))
    assert all(verdict[i].kept for i in range(600))
    assert [n for i, n in enumerate(bad, 600) if verdict[i].kept] == []
    assert_verdicts([("en", "a", t) for t in texts], [verdict[i].kept for i in range(len(texts))])


def test_quality_query_against_plain_estimates(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries_text.op1_quality(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_stats(
            docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    sound = [r for r in rows if not r.base_failed]
    assert_verdicts([(docs[r.doc_id].lang, docs[r.doc_id].source, docs[r.doc_id].text) for r in sound],
                    [r.kept for r in sound])


def test_quality_of_messy_documents(spark):
    docs = documents(spark)
    rows = quality.judge(quality.measure(docs, "doc_id"), quality.fit(quality.measure(docs))).collect()
    assert len(rows) == 12 and not any(r.kept for r in rows if r.n_words < 50)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(nothing(spark)).count() == 0


def test_nearest_is_exact():
    draw = np.random.default_rng(11)
    terms, examples = 40, []
    for n in range(400):
        ids = np.sort(draw.choice(terms, draw.integers(1, 6), replace=False))
        examples.append((ids.tolist(), draw.integers(1, 4, len(ids)).tolist(), int(n % 3 == 0), n))
    index = toxicity.Index.build(draw.random(terms) + 0.5, examples, 10, 8)

    def dense(ids, tfs):
        out = np.zeros(terms)
        out[ids] = index.unit(np.array(ids), np.array(tfs, float))
        return out

    entries = [dense(index.ids[a:b], np.ones(b - a)) * 0 for a, b in zip(index.ends, index.ends[1:])]
    for e, (a, b) in enumerate(zip(index.ends, index.ends[1:])):
        entries[e][index.ids[a:b]] = index.weights[a:b]
    for ids, tfs, _, _ in examples[:120]:
        cosines = np.array(entries) @ dense(ids, tfs)
        order = np.argsort(-cosines, kind="stable")
        reached = np.cumsum(index.votes[order].sum(axis=1))
        last = cosines[order[np.searchsorted(reached, 10)]]
        want = {int(e) for e in range(len(entries)) if cosines[e] > 0 and cosines[e] >= last - 1e-12}
        got, values = index.nearest(np.array(ids), np.array(tfs, float))
        assert set(got.tolist()) == want
        assert np.allclose(values, cosines[got])


def test_blocks_below_the_bound_are_skipped():
    """Examples of twenty subjects: a query looks into the blocks of its own."""
    draw = np.random.default_rng(5)
    examples = []
    for n in range(2000):
        subject = n % 20
        ids = np.sort(draw.choice(15, 8, replace=False)) + 15 * subject
        examples.append((ids.tolist(), draw.integers(1, 4, 8).tolist(), n % 2, n))
    index = toxicity.Index.build(np.ones(300), examples, 10, 32)
    queries = [(np.array(i), np.array(t, float)) for i, t, _, _ in examples[:100]]
    everything = np.zeros((len(index.names), 300))
    for e, (a, b) in enumerate(zip(index.ends, index.ends[1:])):
        everything[e, index.ids[a:b]] = index.weights[a:b]
    for (ids, tfs), (got, values) in zip(queries, index.nearest_all(queries), strict=True):
        dense = np.zeros(300)
        dense[ids] = index.unit(ids, tfs)
        cosines = everything @ dense
        last = np.sort(np.repeat(cosines, index.votes.sum(axis=1).astype(int)))[-10]
        want = np.flatnonzero(cosines >= last - 1e-12)
        assert set(got.tolist()) >= set(want.tolist())
        assert np.allclose(values, cosines[got])
    assert index.visited < index.asked / 4


def plain_scores(docs, labels, bounds):
    """Scores with every document compared with every example, term by term."""
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0 for d, _ in docs}
    known = {}
    for d, toxic in labels:
        if d is not None and toxic is not None and not zlib.crc32(str(d).encode()) % 5 == 0:
            known[d] = max(toxic, known.get(d, 0))
    draw = sorted(known, key=lambda d: hashlib.md5(str(d).encode()).hexdigest())
    chosen = [d for c in (0, 1) for d in [d for d in draw if known[d] == c][:bounds.examples]]
    texts = {d: min((t for i, t in docs if i == d and t is not None), default=None)
             for d in chosen if any(i == d for i, _ in docs)}
    counts = {}
    for d, text in texts.items():
        for term in toxicity.terms_of(text):
            counts.setdefault(term, [0, 0])[known[d]] += 1
    counts = {t: n for t, n in counts.items() if sum(n) >= bounds.min_docs}
    n0, n1 = (float(sum(known[d] == c for d in texts)) for c in (0, 1))
    told = set()
    for term, (b, a) in counts.items():
        square = (n0 + n1) * (a * n0 - b * n1) ** 2 / (n0 * n1 * (a + b) * max(n0 + n1 - a - b, 1))
        if square > 2 * math.log(len(counts)):
            told.add(term)
    found = [{t: n for t, n in toxicity.terms_of(text).items() if t in told} for _, text in docs]
    df = Counter(t for f in found for t in f)

    def unit(terms):
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1)
               for t, n in terms.items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / size for t, x in raw.items()}

    def own(text):
        return unit({t: n for t, n in toxicity.terms_of(text).items() if t in told})

    examples = [(own(text), known[d], d) for d, text in texts.items()]
    sizes = [sum(v == c for v in known.values()) for c in (0, 1)]
    prior = sizes[1] / sum(sizes)
    lift = [sizes[c] / sum(known[d] == c for d in chosen) for c in (0, 1)]

    def share(query, but=None):
        near = sorted(((sum(x * v.get(t, 0) for t, x in query.items()), toxic)
                       for v, toxic, d in examples if d != but and v), reverse=True)
        last = near[bounds.neighbours - 1][0] if len(near) >= bounds.neighbours else 0
        near = [(s, t) for s, t in near if s > 0 and s >= last - 1e-9]
        weighed = [sum(s * s * lift[c] for s, t in near if t == c) for c in (0, 1)]
        value = (weighed[1] + 0.5 * prior) / (sum(weighed) + 0.5)
        return min(max(value, 1e-4), 1 - 1e-4)

    tried = [(share(v, d), toxic) for v, toxic, d in examples if v]
    slope, offset = toxicity.fit_logistic(
        np.array([math.log(s / (1 - s)) for s, _ in tried]), np.array([t for _, t in tried], float),
        np.array([lift[t] for _, t in tried]))
    bare = [lift[c] * sum(t == c for v, t, _ in examples if not v) for c in (0, 1)]
    none = (bare[1] + prior) / (sum(bare) + 1)
    out = []
    for (d, _), terms in zip(docs, found, strict=True):
        s = share(unit(terms)) if terms else None
        out.append((d, held[d], none if s is None else 1 / (
            1 + math.exp(-(slope * math.log(s / (1 - s)) + offset)))))
    return sorted(out, key=str)


def test_scores_against_every_example(spark):
    """Repeated label rows and a sampled id with two texts change nothing but that id's rows."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(
        "doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select(
        "doc_id", "toxic").collect()]
    first = next(d for d, t in labels if t == 1 and zlib.crc32(str(d).encode()) % 5)
    docs.append((first, "another text of the same id"))
    labels += [r for r in labels if r[1] == 1] * 3
    bounds = toxicity.Bounds(examples=60, neighbours=5)
    made = toxicity.score_documents(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"), bounds)
    got = sorted(((r.doc_id, r.held_out, r.score) for r in made.collect()), key=str)
    for a, b in zip(got, plain_scores(docs, labels, bounds), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-6), (a, b)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    scores = queries_text.op2_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    good = [r.score for r in rows if r.toxic == 0]
    bad = [r.score for r in rows if r.toxic == 1]
    pairs = [(b > g) + (b == g) / 2 for b in bad for g in good]
    assert sum(pairs) / len(pairs) > 0.75
    # held-out labels are not looked at
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    turned = labels.withColumn("toxic", F.when(
        toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.score_documents(docs, turned).select("doc_id", "score")
    assert same.exceptAll(scores.select("doc_id", "score")).isEmpty()


def test_every_telling_term_is_in_the_vocabulary(spark):
    """400 words, each in 20 toxic and no clean examples: more than 256 terms tell."""
    words = ["".join("abcdefghij"[int(c)] for c in f"{n:03d}") for n in range(400)]
    rows = [(" ".join(words[(20 * i + k) % 400] for k in range(20)), 1) for i in range(400)]
    rows += [("plain", 0)] * 400
    texts = spark.createDataFrame(rows, "text string, toxic int")
    assert set(toxicity.choose_terms(texts, toxicity.Bounds())) == {*words, "plain", "pla*"}


def test_toxicity_of_messy_documents(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (None, 1), (7, None)],
                                   "doc_id long, toxic int")
    rows = toxicity.score_documents(documents(spark), labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.score_documents(documents(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_documents(nothing(spark), labels).count() == 0


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [words] if 0 < len(words) < 3 else [words[i:i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_of_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(texts, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in queries_text.op3_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("cell", [3, 4096])
def test_all_links_are_found(spark, cell):
    """Clusters around random centres, with up to 6 bits between members; small cells make the
    grid of a hot anchor."""
    draw, found = random.Random(cell), {0, 7, (1 << 64) - 1}
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            found.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in found]
    want = plain_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.link_fingerprints(frame, cell)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert {f: got.get(f, f) for f in signed} == want
    assert links.count() < 20 * len(signed)


def test_deduplicating_messy_documents(spark):
    docs = documents(spark)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    prints = {r.doc_id or -1: plain_fingerprint(r.text) for r in docs.collect()
              if r.doc_id or r.text}  # -1: the text without an id
    roots = plain_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert ids == sorted(set(roots.values()))
    assert simhash.deduplicate(nothing(spark)).count() == 0


ITEM = "item_id long, text string, n_hit int"


def test_contamination_edges(spark, monkeypatch):
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([
        (1, f"x {phrase.upper()} y {phrase}, {phrase}!"), (1, "alpha beta"), (2, None), (3, ""),
        (None, "so Short-one, yes"), (4, "kappa " + phrase.replace("gamma", "x")),
        (5, "iota kappa alpha gamma beta delta zeta epsilon eta theta"),
        (6, "short"), (7, "one short one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, phrase + " lambda", 0), (2, phrase, 0), (3, "short one", 0),
                                   (4, None, 0), (5, "...", 0), (6, "absent", 0)], ITEM)
    index = decontam.build_index(docs)

    def found(**bounds):
        return sorted(((r.doc or 0, r.n_words, r.n_hit, r.item_ids, r.n_near_items) for r in
                       decontam.contamination(index, decontam.search(index, items)).collect()),
                      key=str)

    want = sorted([(1, 32, 30, ["1", "2"], 2), (1, 2, 0, [], 0), (2, 0, 0, [], 0), (3, 0, 0, [], 0),
                   (0, 4, 2, ["3"], 1), (4, 11, 0, [], 0), (5, 10, 0, [], 2), (6, 1, 0, [], 0),
                   (7, 3, 2, ["3"], 1)], key=str)
    assert found() == want
    monkeypatch.setattr(decontam, "WORDS_PER_BLOCK", 8)  # several blocks
    assert found() == want
    left = decontam.remove_contaminated(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 5, 6]


def test_decontaminating_messy_documents(spark):
    items = spark.createDataFrame([(1, "漢字 é ü", 0)], ITEM)
    docs = documents(spark)
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 11
    assert decontam.remove_contaminated(docs, items.limit(0)).count() == 12
    assert decontam.remove_contaminated(nothing(spark), items).count() == 0
    index = decontam.build_index(nothing(spark))
    assert decontam.contamination(index, decontam.search(index, items)).count() == 0


@pytest.mark.parametrize("piece", [3, 7, 50])
def test_long_items_are_searched_in_pieces(spark, monkeypatch, piece):
    draw = random.Random(6)
    words = [f"w{draw.randrange(30)}" for _ in range(120)]
    cuts = [words[a:a + n] for a, n in ((0, 10), (5, 9), (30, 40), (110, 10), (61, 25))]
    docs = [(i, " ".join(["x", *cut, "y", *words[i * 7:i * 7 + 12]])) for i, cut in enumerate(cuts)]
    items = [(1, " ".join(words)), (2, " ".join(words)), (None, " ".join(words[20:60])),
             (3, "w1"), (None, "w2"), (4, None)]
    monkeypatch.setattr(decontam.item_pieces, "__defaults__", (10, piece))
    monkeypatch.setattr(decontam, "WORDS_PER_BLOCK", 60)
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    found = decontam.contamination(index, decontam.search(
        index, spark.createDataFrame(items, "item_id long, text string")))
    got = {r.doc: (r.n_hit, r.n_items, r.item_ids) for r in found.collect()}
    for doc, text in docs:
        own, hit, names = decontam.words_of(text), set(), set()
        for item, other in items:
            wanted = decontam.windows_of(decontam.words_of(other))
            for n in {len(w) for w in wanted}:
                for i in range(len(own) - n + 1):
                    if tuple(own[i:i + n]) in wanted:
                        hit.update(range(i, i + n))
                        names.add(item)
        assert got[doc] == (len(hit), len(names), sorted(str(n) for n in names if n is not None))


def test_columns_of_any_name_pass_through(spark):
    """A dot, a quote and the names that the operators use themselves."""
    names = {"kept": "a.b", "fp": "c`d", "digest": "bad_digest", "row": "wanted", "slot": "key"}
    docs = documents(spark).drop("key")
    docs = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns])
    items = spark.createDataFrame([(1, "漢字 é ü", 0)], ITEM)
    stages = {
        "quality": quality.keep_good, "copies": simhash.deduplicate,
        "leaks": lambda d: decontam.remove_contaminated(d, items), "mix": mixing.mixed_rows}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert out.count() > 0, name
    placed = sharding.place(docs, SHARDS, SLOTS)
    assert placed.columns == [c for c in docs.columns if c != "shard"] + ["slot", "shard"]
    assert placed.count() == docs.count()
    assert tokens.count_tokens(docs).count() >= docs.count()
    assert linededup.deduplicate_lines(docs).count() == docs.count()


def test_shards_of_an_index(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_WORDS", 50)
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i} a{i % 3} c") for i in range(40)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "a1 c", 0), (2, "b7 a1 c", 0)], ITEM)
    index = decontam.build_index(docs)
    assert index.select("shard").distinct().count() > 4
    got = {r.doc: r.item_ids for r in
           decontam.contamination(index, decontam.search(index, items)).collect()}
    assert got == {i: (["1"] if i % 3 == 1 else []) + (["2"] if i == 7 else []) for i in range(40)}


def test_alignment_is_common_and_rising():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(14))] for _ in range(2))
        pairs = linededup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if set(a) & set(b):
            assert pairs
    assert linededup.align("abcdef", "xbcyef") == [(1, 1), (2, 2), (4, 4), (5, 5)]


def test_common_blocks_go_from_the_later_document(spark):
    passage = "one two three four five six seven eight nine\nten eleven twelve"
    rows = [(1, f"first line of its own here\n{passage}\nend a"), (2, f"other\n\n{passage}\n\nend b"),
            (3, f"{passage}"), (4, f"{passage}"), (5, "end a"), (6, "Unrelated text, of one line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted, r.copied)
           for r in linededup.deduplicate_lines(docs).collect()}
    assert got == {1: (rows[0][1], 0, False), 2: ("other\n\n\nend b", 2, False), 3: ("", 2, False),
                   4: ("", 2, True), 5: ("end a", 0, False), 6: (rows[5][1], 0, False)}


def test_hot_lines_make_no_pairs_but_stars(spark):
    line = "a line that very many of the documents have in common"
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(
        F.lit(line + "\nown words of number "), F.col("id")).alias("text"))
    rows = linededup.deduplicate_lines(docs).collect()
    assert sum(r.n_partners for r in rows) == 399
    assert all(r.n_deleted == (r.doc_id > 0) for r in rows)


@pytest.mark.parametrize("n", [101, 5000])
def test_short_lines_of_very_many_texts_go(spark, n):
    passage = "\n".join(f"short line {i}" for i in range(20))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("number "), F.col("id"), F.lit("\n" + passage)).alias("text"))
    rows = linededup.deduplicate_lines(docs).select("doc_id", "n_deleted").collect()
    assert all(r.n_deleted == (20 if r.doc_id else 0) for r in rows) and len(rows) == n


def test_lines_against_all_pairs(spark):
    """Few different lines, so that most have an earlier holder elsewhere: every run of five words
    that any earlier text has goes, and with it all that patience diffs of all pairs find."""
    draw = random.Random(4)
    lines = ["a b c", "d e f", "g h", "i", "j k l m n o", "p q", "r s t u", ""]
    texts = ["a b c\n1", "d e f\n2", "a b c\nd e f\n3", "a b c\nd e f\n4"]
    texts += ["\n".join([*draw.choices(lines, k=draw.randrange(1, 7)), str(i)]) for i in range(5, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicate_lines(docs).collect()}
    parsed = [[(n, p, x, len(x.split())) for p, (n, x) in enumerate(
        (n, x) for n, x in enumerate(text.split("\n")) if x)] for text in texts]

    def runs(own):
        spans = [own[i:j] for i in range(len(own)) for j in range(i + 1, len(own) + 1)]
        return [(tuple(x[2] for x in s), {x[0] for x in s}) for s in spans
                if sum(x[3] for x in s) >= 5]

    for i, own in enumerate(parsed):
        before = {key for earlier in parsed[:i] for key, _ in runs(earlier)}
        want = set().union(*(at for key, at in runs(own) if key in before))
        hashes, sizes = [x[2] for x in own], [x[3] for x in own]
        pairs = {own[j][0] for e in parsed[:i] for block in linededup.aligned_blocks(
            [x[2] for x in e], hashes, sizes, 5) for j in block}
        assert pairs <= want
        left = [x for n, x in enumerate(texts[i].split("\n")) if n not in want]
        assert (got[i].text, got[i].n_deleted) == ("\n".join(left), len(want))
    assert got[3].n_deleted == 2


def test_lines_of_messy_documents(spark):
    rows = linededup.deduplicate_lines(documents(spark)).collect()
    assert len(rows) == 12
    assert [r.n_deleted for r in rows if r.doc_id == 1] == [0, 0]
    assert linededup.deduplicate_lines(nothing(spark)).count() == 0


def test_tokens_lie_where_another_tokenizer_puts_them(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    got = {(r.doc_id, r.section): r.n_tokens for r in
           tokens.count_tokens(docs, rule="first").collect()}
    want = {}
    for row in docs.collect():
        starts = [0] + [m.end() for m in re.finditer("\n", row.text)]
        starts = [s for s in starts if s < len(row.text) or s == 0]
        want |= {(row.doc_id, i): 0 for i in range(len(starts))}
        for begun, _ in other.encode(row.text, add_special_tokens=False).offsets:
            want[row.doc_id, int(np.searchsorted(starts, begun, "right")) - 1] += 1
    assert got == want


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_are_allocated_byte_by_byte(spark, rule):
    """The library's ids, the bytes of each token, and the rule applied to one token at a time."""
    from tokenizers import Tokenizer

    from cliploom.llm import bpe

    other, spelled = Tokenizer.from_file(bpe.VOCABULARY), bpe.Vocabulary.read(bpe.VOCABULARY).tokens
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 30").collect()]
    texts += ["a\n\n\nb", "\n", "\n\n  \n x", "é\n漢字\n\n", "x  \n\n  y", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing)
           for r in tokens.count_tokens(docs, rule=rule).collect()}
    want = {}
    for doc, text in enumerate(texts):
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + [lines[-1]] * bool(lines[-1] or len(lines) == 1)
        owner = [i for i, line in enumerate(lines) for _ in line.encode()]
        want |= {(doc, i): [0, 0] for i in range(len(lines))}
        at = 0
        for token in other.encode(text, add_special_tokens=False).ids:
            own = Counter(owner[at:at + len(spelled[token])])
            at += len(spelled[token])
            chosen = {"first": min(own), "last": max(own),
                      "most": min(own, key=lambda i: (-own[i], i))}[rule]
            want[doc, chosen][0] += 1
            want[doc, chosen][1] += len(own) > 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_boundary_rules():
    ends = np.array([0, 4, 5, 9])
    bounds = np.array([0, 3, 5, 7])  # the second token has its middle byte across
    for rule, want in (("first", [0, 2, 2]), ("last", [1, 2, 2]), ("most", [0, 2, 2])):
        sections, crossing = tokens.sections_of(np.array([0, 4, 5, 7]), bounds[:4], rule)
        assert sections.tolist() == [{"first": 0, "last": 1, "most": 0}[rule], 1, 2]
        assert crossing.tolist() == [True, False, False]
    assert len(ends) == 4


def test_tokens_of_messy_documents(spark):
    rows = tokens.count_tokens(documents(spark), ("source", "text")).collect()
    assert {(r.doc_id, r.field) for r in rows} >= {(2, "text"), (3, "source"), (None, "text")}
    assert sum(r.section == 0 and r.field == "text" for r in rows) == 12
    assert tokens.count_tokens(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(documents(spark), rule="other")


def plain_mix(rows, targets):
    """Copies of every (doc_id, source, text): whole epochs, then by key until the target."""
    copies = {}
    for source in {r.source for r in rows}:
        own = []
        for r in (r for r in rows if r.source == source):
            size = len(WORD.findall(r.text))
            weight = size / (size + len(re.findall(r"[#*$%&|<>]", r.text))) if size else 1.0
            u = (int(hashlib.md5(f"{r.doc_id}/mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            own.append((-math.log(u) / weight, r.doc_id, size))
        whole = sum(size for _, _, size in own)
        epochs = int(targets[source] // whole)
        before, rest = 0, targets[source] - epochs * whole
        for _, doc_id, size in sorted(own):
            copies[doc_id] = epochs + (before + size / 2 <= rest)
            before += size
    return copies


def test_pipeline_against_plain_code(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [decontam.words_of(r.text) for r in
             spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {w for words in items for w in decontam.windows_of(words)}
    columns, rows = docs.columns, docs.collect()
    made = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, docs, SMALL)
        assert frame.columns == columns + ["slot", "shard"] * (i == 4)
        frame.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        made.append(docs.collect())
    ids = [sorted(r.doc_id for r in stage) for stage in made]

    sound = [r for r in rows if (s := plain_stats(r.text))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert_verdicts([(r.lang, r.source, r.text) for r in sound],
                    [r.doc_id in set(ids[0]) for r in sound])
    assert set(ids[0]) <= {r.doc_id for r in sound} and len(ids[0]) < len(sound)
    sound = made[0]

    prints = {r.doc_id: plain_fingerprint(r.text) for r in sound}
    roots = plain_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert ids[1] == sorted(set(roots.values()))

    def leaked(text):
        words = decontam.words_of(text)
        return any(tuple(words[i:i + n]) in windows
                   for n in {len(w) for w in windows} for i in range(len(words) - n + 1))

    assert ids[2] == [r.doc_id for r in sorted(made[1]) if not leaked(r.text)]

    sizes = {}
    for r in made[2]:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    copies = plain_mix(made[2], fair_shares(sizes, weights, 1.5 * sum(sizes.values()), 2))
    assert ids[3] == sorted(d for d, n in copies.items() for _ in range(n))

    owner = sharding.fill_slots(SHARDS, SLOTS)
    for r in made[4]:
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SLOTS
        assert r.shard == SHARDS[owner[r.slot]]
    assert ids[4] == ids[3] and PROSE
