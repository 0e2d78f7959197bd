"""Line deduplication by aligning documents that share rare runs of lines.

Partners. A run is a few lines that follow each other (blank lines aside) and have BLOCK words
together: from every line the shortest that begins there and the shortest that ends there. Any
common block of two texts with BLOCK words or more is made of runs that both have. Texts are
ordered by id. Of all texts that have a run only the first, its holder, is a partner of the others,
so a run that any number of texts share makes a star and not all pairs; within a text such a run
is as telling as a rare line, and short or frequent lines find partners only together.

Alignment. Each later text is aligned with each of its partners by patience diff, and aligned blocks
of BLOCK words go from the later text. Shared runs that a diff leaves because they stand in another
order or again go with the block around them. So no other text need be asked: what a diff with any
earlier text would find is in runs that a partner holds.

Equal texts are one text throughout; of the documents that have it, all but the first lose every
line. A text that a third of all documents copy is one row in every join.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import column, word_count
from cliploom.session import write_stage

#: A run of lines that an earlier text has is deleted if it has BLOCK words.
BLOCK = 5


def _unique_pairs(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of items that occur once in both. If there are none, the n-th occurrences of an
    item are taken as a pair."""
    in_a, in_b = Counter(a), Counter(b)
    if any(n == 1 and in_b.get(x) == 1 for x, n in in_a.items()):
        place = {x: j for j, x in enumerate(b) if in_b[x] == 1}
        return [(i, place[x]) for i, x in enumerate(a) if in_a[x] == 1 and x in place]
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    seen: Counter = Counter()
    pairs = []
    for i, x in enumerate(a):
        if seen[x] < len(places.get(x, ())):
            pairs.append((i, places[x][seen[x]]))
            seen[x] += 1
    return pairs


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rise in both places, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = int(np.searchsorted(tops, j))
        if pile == len(tops):
            tops.append(j)
            heads.append(n)
        else:
            tops[pile], heads[pile] = j, n
        back.append(heads[pile - 1] if pile else -1)
    found, n = [], heads[-1] if heads else -1
    while n >= 0:
        found.append(pairs[n])
        n = back[n]
    return found[::-1]


def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places (in a, in b) of equal items, rising in both, by patience diff: what two texts have in
    common in the same order."""
    found = []
    open_parts = [(0, len(a), 0, len(b))]
    while open_parts:
        a0, a1, b0, b1 = open_parts.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _longest_rising(_unique_pairs(a[a0:a1], b[b0:b1]))
        if anchors:
            found += [(a0 + i, b0 + j) for i, j in anchors]
            ends = [(-1, -1), *anchors, (a1 - a0, b1 - b0)]
            open_parts += [(a0 + i + 1, a0 + k, b0 + j + 1, b0 + m)
                           for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def aligned_blocks(earlier: Sequence, later: Sequence, words: Sequence[int], least: int
                   ) -> list[range]:
    """Indices (into later) of the blocks with `least` words that a patience diff aligns."""
    found: list[range] = []
    begin, before = 0, (-2, -2)
    for i, j in [*align(earlier, later), (-2, -2)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            found.append(range(begin, before[1] + 1))
            begin = j
        before = (i, j)
    return [block for block in found if sum(words[j] for j in block) >= least]


def common_lines(earlier: Sequence, later: Sequence, words: Sequence[int], least: int) -> list[int]:
    """Indices of the lines that the later text loses to the earlier one. words: of each later
    line, 1 at least.

    Aligned blocks go first. A diff keeps to one order and takes every line once; a run that it
    left although both texts have it goes with the block around it, as far as the texts agree."""
    lost = set(itertools.chain(*aligned_blocks(earlier, later, words, least)))
    places = defaultdict(list)
    for i, x in enumerate(earlier):
        places[x].append(i)
    for begin, end in runs_of(words, least):
        if lost.issuperset(range(begin, end)):
            continue
        for i in places.get(later[begin], ()):
            if earlier[i:i + end - begin] == later[begin:end]:
                j = begin
                while i and j and earlier[i - 1] == later[j - 1]:
                    i, j = i - 1, j - 1
                while i < len(earlier) and j < len(later) and earlier[i] == later[j]:
                    lost.add(j)
                    i, j = i + 1, j + 1
                break
    return sorted(lost)


def runs_of(words: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Begins and ends of the shortest runs of lines that have `least` words. words: of each line,
    1 at least."""
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    begins = np.arange(len(words))
    ends = np.searchsorted(before, before[:-1] + least)
    at = ends <= len(words)
    found = set(zip(begins[at].tolist(), ends[at].tolist(), strict=True))
    starts = np.searchsorted(before, before[1:] - least, side="right") - 1
    at = starts >= 0
    return sorted(found | set(zip(starts[at].tolist(), (begins[at] + 1).tolist(), strict=True)))


def _run_maker(least: int):
    """One row per text and run: the hash of the run."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, first_id, hashes, words in frame.itertuples(index=False):
                at = np.flatnonzero(words)
                spoken = np.asarray(hashes, np.int64)[at]
                keys = {xxhash.xxh64_intdigest(spoken[begin:end].tobytes()) - (1 << 63)
                        for begin, end in runs_of(np.asarray(words)[at], least)}
                rows += [(digest, first_id, key) for key in keys]
            yield pd.DataFrame(rows, columns=["digest", "first_id", "run"])

    return run


def _aligner(least: int):
    """One row per pair of a text and a partner: the lines that the text loses to it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, leader, theirs, own, words in frame.itertuples(index=False):
                at = np.flatnonzero(words)
                lost = common_lines(list(theirs), np.asarray(own)[at].tolist(),
                                    np.asarray(words)[at].tolist(), least)
                rows.append((digest, leader, at[lost].tolist()))
            yield pd.DataFrame(rows, columns=["digest", "leader", "lost"])

    return run


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def find_deletions(docs: DataFrame, least: int = BLOCK) -> DataFrame:
    """(digest, first_id, lost, n_partners) for every text that shares anything: the smallest id
    that has the text, the lines that its first document loses, and to how many partners. docs: doc_id, text."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    # white space at the ends of a line does not tell lines apart
    bare = F.transform(_lines(F.col("text")), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")))
    texts = write_stage(
        docs.select("doc_id", digest.alias("digest"),
                    F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("hash"),
                                                         word_count(x).cast("int").alias("words")))
                    .alias("lines"))
        .groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
                               F.first("lines").alias("lines")), "texts")
    id_type = texts.schema["first_id"].dataType.simpleString()
    named = texts.select("digest", F.col("first_id").cast("string"), F.col("lines.hash").alias("hash"),
                         F.col("lines.words").alias("words"))
    runs = write_stage(
        named.mapInPandas(_run_maker(least), "digest string, first_id string, run long")
        .withColumn("first_id", F.col("first_id").cast(id_type)), "runs")
    rank = F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "digest")
    # written before it meets the runs, so that the join can deal a hot run to many tasks
    shared = write_stage(
        runs.groupBy("run").agg(F.count("*").alias("n"), F.min(rank).alias("first"))
        .where("n > 1").select("run", F.col("first.digest").alias("leader")), "holders")
    pairs = write_stage(
        runs.select("digest", "run").join(shared, "run").where("digest <> leader")
        .select("digest", "leader").distinct(), "pairs")
    theirs = F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["hash"])
    lost = (
        pairs.join(texts.select(F.col("digest").alias("leader"), theirs.alias("theirs")), "leader")
        .join(texts.select("digest", F.col("lines.hash").alias("own"),
                           F.col("lines.words").alias("words")), "digest")
        .select("digest", "leader", "theirs", "own", "words")
        .mapInPandas(_aligner(least), "digest string, leader string, lost array<int>")
        .where(F.size("lost") > 0).groupBy("digest")
        .agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"),
             F.count("*").alias("n_partners"))
    )
    return texts.select("digest", "first_id", "copies").join(lost, "digest", "left").where(
        "copies > 1 or n_partners > 0").select(
        "digest", "first_id", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"),
        F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"))


def deduplicate_lines(docs: DataFrame, least: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted, n_partners, copied, text (what is left).

    copied: the text is that of a document with a smaller id; all its lines are deleted. Rows
    that repeat an id with the same text are the same document and are treated alike; an id with
    two texts is two documents, the one with the smaller digest first. Null ids come last. Null
    texts are empty: one line without words, never deleted, and text stays null or empty. An
    empty table gives an empty result. Further columns are ignored, whatever their names."""
    docs = docs.select(column("doc_id").alias("doc_id"), column("text").cast("string").alias("text"))
    found = write_stage(find_deletions(docs, least), "deletions")
    digest = F.md5(F.coalesce("text", F.lit("")))
    joined = docs.withColumn("digest", digest).join(found, "digest", "left")
    lines = _lines(F.col("text"))
    copied = (~F.col("doc_id").eqNullSafe(F.col("first_id"))) & F.col("n_partners").isNotNull() & (
        word_count(F.col("text")) > 0)
    lost = F.coalesce("lost", F.array().cast("array<int>"))
    return joined.select("doc_id", "text", lines.alias("lines"), "lost", "n_partners",
                         copied.alias("copied")).select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("copied"), F.size("lines")).otherwise(F.size(lost)).cast("long")
        .alias("n_deleted"),
        F.coalesce("n_partners", F.lit(0)).alias("n_partners"), "copied",
        F.when(F.col("copied"), F.lit("")).when(F.size(lost) == 0, F.col("text"))
        .otherwise(F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost),
            lambda i: F.col("lines")[i]), "\n")).alias("text"))
