"""Ranked search of many items at once, by sums that items share.

Documents are dealt into shards, and a task builds the inverted lists of its own shard: storing the
index shuffles nothing, and a word that every document has is a row per shard, never one long list.

A document's score for an item is a sum over the item's terms, so items that have terms in common
have sums in common. The items of a block are mined for them: terms that stand in the same items
are one set; then the two sets that stand together in most items become a set of their own, again
and again, until no two stand together twice. That gives a graph of sums. In every shard each sum
is made once, as an array with a number for each document (a partial accumulator), and dropped
after its last use; an item is the sum of the few sets that are left of it. All documents are
scored, and the best of every shard meet in a last ranking.
"""

from __future__ import annotations

import functools
import heapq
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import column, lower_ascii
from cliploom.llm.decontam import words_of
from cliploom.session import write_stage

TOP = 20
#: Fixed value: maximal runs of ASCII letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A shard is closed at so many words or documents.
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 13
#: (item, term) pairs of a block of items: what the driver and a task hold of the items at a time.
BLOCK_TERMS = 100_000
#: Sets of an item that take part in mining, those of most items first. The others are added one by
#: one, so this says how much is shared, not what is found.
MINED = 256


class _Shard:
    """The inverted lists of one shard while its documents come in."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.docs: list = []
        self.sizes: list[int] = []
        self.found: list[np.ndarray] = []
        self.words = 0

    def add(self, doc: pa.Scalar, text: str | None) -> None:
        found = np.fromiter(map(self.ids.__getitem__, words_of(text)), np.int64)
        self.docs.append(doc)
        self.sizes.append(len(found))
        self.found.append(found)
        self.words += len(found)

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or len(self.docs) >= SHARD_DOCS

    def rows(self, shard: int, kind: pa.DataType) -> pa.RecordBatch:
        """A list per term, and a row without a term for the documents and their sizes."""
        sizes = np.array(self.sizes, np.int64)
        pairs = np.concatenate([*self.found, np.empty(0, np.int64)]) << 32
        pairs, tf = np.unique(pairs | np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        counts = np.bincount(pairs >> 32, minlength=len(self.ids))
        ends = np.concatenate([[0], np.cumsum(counts)])
        postings = np.column_stack([pairs & 0xFFFFFFFF, tf]).astype("<i4")
        lists = pa.Array.from_buffers(
            pa.binary(), len(counts),
            [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(postings.tobytes())])
        n = len(counts)
        docs = pa.array([d.as_py() for d in self.docs], kind)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, shard)),
            pa.array([None, *self.ids], pa.binary()).cast(pa.string()),
            pa.array([int((sizes > 0).sum()), *counts.tolist()], pa.int64()),
            pa.array([int(sizes.sum())] + [None] * n, pa.int64()),
            pa.concat_arrays([pa.array([sizes.astype("<i8").tobytes()], pa.binary()), lists]),
            pa.ListArray.from_arrays(pa.array([0] + [len(docs)] * (n + 1), pa.int32()), docs),
        ], ["shard", "term", "n_docs", "n_words", "postings", "docs"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard, kind = TaskContext.get().partitionId() << 24, _Shard(), None
    for batch in batches:
        kind = batch.column("doc").type
        for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
            shard.add(doc, text.as_py())
            if shard.full():
                yield shard.rows(number, kind)
                number, shard = number + 1, _Shard()
    if shard.docs:
        yield shard.rows(number, kind)


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Store the inverted index of docs (columns key, text) and return it.

    One row per (shard, term): n_docs, and postings of (place, occurrences) as 32-bit numbers; one
    row per shard without a term: its documents by place, their sizes in 64-bit numbers as
    postings, how many have terms (n_docs) and how many terms they have together (n_words). Every
    row of docs has a place, repeated and null ids included; null texts have no terms."""
    rows = docs.select(column(key).alias("doc"), column("text").cast("string").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return write_stage(rows.mapInArrow(
        _index, "shard long, term string, n_docs long, n_words long, postings binary, "
                f"docs array<{kind}>"), "term-index")


@dataclass
class Graph:
    """Sums that items share. A set is a list of (term, times) or two sets before it."""

    leaves: dict[int, list[tuple[str, int]]]
    sums: dict[int, tuple[int, int]]
    items: list[list[int]]  # the sets that make up each item

    def uses(self) -> Counter:
        return Counter(itertools.chain(*self.sums.values(), *self.items))


def _pairs(sets: set[int], users: dict[int, set[int]]) -> Iterator[tuple[int, int]]:
    shared = sorted((s for s in sets if len(users[s]) > 1), key=lambda s: (-len(users[s]), s))
    return itertools.combinations(sorted(shared[:MINED]), 2)


def mine(items: list[Counter]) -> Graph:
    """The graph of a block of items (term: times)."""
    held: dict[tuple[str, int], list[int]] = defaultdict(list)
    for i, terms in enumerate(items):
        for term, times in terms.items():
            for k in range(times):  # the k-th occurrence is shared with items that have so many
                held[term, k].append(i)
    same: dict[tuple, Counter] = defaultdict(Counter)
    for (term, _), users in held.items():
        same[tuple(users)][term] += 1
    leaves, users, rest = {}, {}, [set() for _ in items]
    for number, (who, terms) in enumerate(same.items()):
        leaves[number], users[number] = list(terms.items()), set(who)
        for i in who:
            rest[i].add(number)
    together = Counter(itertools.chain.from_iterable(_pairs(sets, users) for sets in rest))
    waiting = [(-n, pair) for pair, n in together.items() if n > 1]
    heapq.heapify(waiting)
    sums: dict[int, tuple[int, int]] = {}
    while waiting:
        n, (a, b) = heapq.heappop(waiting)
        now = together[a, b]
        if now < 2:
            continue
        if now < -n:
            heapq.heappush(waiting, (-now, (a, b)))
            continue
        number = len(leaves) + len(sums)
        who = {i for i in users[a] & users[b] if a in rest[i] and b in rest[i]}
        sums[number], users[number] = (a, b), who
        for i in who:
            rest[i] -= {a, b}
            for other in rest[i]:
                for lost in (a, b):
                    pair = (lost, other) if lost < other else (other, lost)
                    if pair in together:
                        together[pair] -= 1
                        together[other, number] += 1
            rest[i].add(number)
        together[a, b] = 0
        users[a] -= who
        users[b] -= who
        for other in {o for i in who for o in rest[i]} - {number}:
            together[other, number] = len(users[other] & who)
            if together[other, number] > 1:
                heapq.heappush(waiting, (-together[other, number], (other, number)))
    return Graph(leaves, sums, [sorted(sets) for sets in rest])


def _accumulators(graph: Graph, part, size: int) -> Iterator[np.ndarray]:
    """The scores of all documents of a shard, item by item. part(term): places and numbers."""
    left, made = graph.uses(), {}

    def used(number: int) -> np.ndarray:
        """A set's sum for one of its uses."""
        todo = [number]
        while todo:
            at = todo[-1]
            if at in made:
                todo.pop()
                continue
            if at in graph.sums:
                missing = [s for s in graph.sums[at] if s not in made]
                if missing:
                    todo += missing
                    continue
                a, b = graph.sums[at]
                made[at] = made[a] + made[b]
                for child in (a, b):
                    drop(child)
            else:
                total = np.zeros(size, np.int64)
                for term, times in graph.leaves[at]:
                    places, numbers = part(term)
                    total[places] += times * numbers
                made[at] = total
            todo.pop()
        return made[number]

    def drop(number: int) -> None:
        left[number] -= 1
        if not left[number]:
            del made[number]

    for sets in graph.items:
        total = np.zeros(size, np.int64)
        for number in sets:
            total += used(number)
            drop(number)
        yield total


def _best(scores: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` highest scores above 0, equal ones by `order`."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]
    return at[np.lexsort((order[at], -scores[at]))][:top]


def _searcher(graph: Graph, weights: dict[str, int], n: int, total: int, top: int):
    """The search of one shard for a block of items."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists, docs, sizes = {}, None, None
        for term, data, own in zip(table["term"].to_pylist(), table["postings"], table["docs"],
                                   strict=True):
            if term is None:
                docs, sizes = own.values, np.frombuffer(data.as_py(), "<i8")
            else:
                lists[term] = np.frombuffer(data.as_py(), "<i4").reshape(-1, 2).astype(np.int64)
        m = 75 + 25 * sizes * n // total
        order = np.empty(len(sizes), np.int64)
        order[pc.array_sort_indices(docs).to_numpy()] = np.arange(len(sizes))

        def part(term: str) -> tuple[np.ndarray, np.ndarray]:
            found = lists.get(term)
            if found is None:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            tf = found[:, 1]
            return found[:, 0], weights[term] * (
                1_000_000_000 * tf // (1000 * tf + 12 * m[found[:, 0]]))

        items, places, scores = [], [], []
        for item, sums in enumerate(_accumulators(graph, part, len(sizes))):
            at = _best(sums, order, top)
            items.append(np.full(len(at), item, np.int64))
            places.append(at)
            scores.append(sums[at])
        return pa.table({
            "item": np.concatenate(items), "doc": docs.take(pa.array(np.concatenate(places))),
            "score": np.concatenate(scores)})

    return run


def search(index: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc (the index's key), score: the `top` highest-scoring documents of every row
    of benchmark (item_id, text), best first, fewer if fewer score above 0.

    Equal scores are ranked by key, null keys last; rows of one key are ranked each. Rows of one
    item_id are items each, null ids included; items with one text are searched once. Items without
    terms and empty tables find nothing. Further columns are ignored, whatever their names.

    Items are taken in blocks of about BLOCK_TERMS terms; the results of a block are written before
    the next, so that the driver holds one block. An item is in one block whole: its terms are at
    most the words of its own text."""
    spark = index.sparkSession
    named = benchmark.select(
        column("item_id").alias("item_id"),
        F.coalesce(column("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("digest", F.md5("text"))
    terms = write_stage(
        named.groupBy("digest").agg(F.first("text").alias("text"))
        .select("digest", F.explode(F.regexp_extract_all(
            lower_ascii(F.col("text")), F.lit(TERM), 0)).alias("term"))
        .groupBy("digest", "term").agg(F.count("*").alias("times")), "item-terms")
    corpus = index.where("term is null").agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l"))
    n, total = corpus.first()
    blocks = -(-terms.count() // BLOCK_TERMS)
    kind = index.schema["docs"].dataType.elementType.simpleString()
    found = [spark.createDataFrame([], f"digest string, doc {kind}, score long")]
    for block in range(blocks if n else 0):
        own = terms.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == block)
        wanted = own.select("term").distinct()
        lists = index.join(wanted, "term", "left_semi")
        share = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.sum("n_docs") + 1)))
        weights = {row.term: row.w for row in
                   lists.groupBy("term").agg(share.cast("long").alias("w")).collect()}
        items: dict[str, Counter] = defaultdict(Counter)
        for row in own.collect():
            if row.term in weights:
                items[row.digest][row.term] = row.times
        digests = sorted(items)
        graph = mine([items[d] for d in digests])
        best = (
            index.where("term is null").unionByName(lists).select("shard", "term", "postings", "docs")
            .groupBy("shard").applyInArrow(
                _searcher(graph, weights, n, total, top), f"item long, doc {kind}, score long")
        )
        names = spark.createDataFrame(list(enumerate(digests)), "item long, digest string")
        found.append(write_stage(
            _ranked(best, "item", top).join(names, "item").select("digest", "doc", "score"),
            "ranked"))
    ranked = _ranked(functools.reduce(DataFrame.unionAll, found), "digest", top)
    return named.select("item_id", "digest").join(ranked, "digest").select(
        "item_id", "rank", "doc", "score")


def _ranked(rows: DataFrame, item: str, top: int) -> DataFrame:
    """The best of every item. Spark keeps the best of each task before the shuffle."""
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
