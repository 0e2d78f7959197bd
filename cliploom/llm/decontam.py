"""Benchmark decontamination with a distributed positional inverted index.

Training documents are dealt into shards of about SHARD_WORDS words. A task builds the inverted
lists of its own shard, one row per (shard, word) with all positions of the word in the shard, so
storing the index shuffles nothing. A word that is in every document is a row per shard, never one
long list.

Searching takes the benchmark in blocks of bounded size. The lists of a block's words are selected
(the words of one block are broadcast, at most WORDS_PER_BLOCK), gathered by shard, and every
window is found by intersecting offset-adjusted lists, from the window's rarest word in the shard
on. Nothing is hashed or sampled: matches are exact, with their positions.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import column, lower_ascii, without
from cliploom.session import write_stage

WINDOW = 10
#: Words of a shard, and positions left free between its documents.
SHARD_WORDS, GAP = 1 << 21, 64
#: Words of a piece of an item, and of the pieces that are searched at once.
PIECE, WORDS_PER_BLOCK = 2_000, 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of words stay (A-Z in lower case), all others become a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128
               else 32 for b in range(256))
FOUND = "shard long, slot int, item long, exact boolean, spans array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


class _Shard:
    """The inverted lists of one shard while its documents come in."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.docs: list[tuple] = []
        self.found: list[np.ndarray] = []
        self.end = 0

    def add(self, doc, text: str | None) -> None:
        found = np.fromiter(map(self.ids.__getitem__, words_of(text)), np.int32)
        self.docs.append((doc, self.end, len(found)))
        self.found.append(found)
        self.end += len(found) + GAP

    def rows(self, shard: int, kind: pa.DataType) -> pa.RecordBatch:
        """First the documents, then the lists, and one list for the starts (no word)."""
        ids = np.concatenate([*self.found, np.empty(0, np.int32)])
        starts = np.array([d[1] for d in self.docs], np.int32)
        sizes = np.array([d[2] for d in self.docs], np.int64)
        at = np.arange(len(ids), dtype=np.int32) + np.repeat(
            starts - (np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(self.ids))
        lists = np.concatenate([starts, at[order]]).astype("<i4")
        counts = np.concatenate([[len(starts)], counts])
        ends = np.concatenate([[0], np.cumsum(counts)])
        lists[1:] -= lists[:-1].copy()  # differences, except at the start of a list
        first = ends[:-1][counts > 0]
        lists[first] = np.concatenate([starts, at[order]])[first]
        terms = pa.array([b"", *self.ids], pa.binary()).cast(pa.string())
        postings = pa.Array.from_buffers(
            pa.binary(), len(terms),
            [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(lists)])
        n, m = len(self.docs), len(terms)
        none = [None] * m
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + m, shard)),
            pa.concat_arrays([pa.nulls(n, pa.string()), terms]),
            pa.concat_arrays([pa.nulls(n, pa.binary()), postings]),
            pa.array([d[0] for d in self.docs] + none, kind),
            pa.array(list(range(n)) + none, pa.int32()),
            pa.array([d[2] for d in self.docs] + none, pa.int64()),
        ], ["shard", "term", "postings", "doc", "slot", "n_words"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard, kind = TaskContext.get().partitionId() << 24, _Shard(), None
    for batch in batches:
        docs, texts = batch.column("doc"), batch.column("text")
        kind = docs.type
        for doc, text in zip(docs, texts, strict=True):
            shard.add(doc.as_py(), text.as_py())
            if shard.end >= SHARD_WORDS:
                yield shard.rows(number, kind)
                number, shard = number + 1, _Shard()
    if shard.docs:
        yield shard.rows(number, kind)


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Store the positional index of docs (columns key, text) and return it.

    Rows with a null term are the documents: (shard, slot, doc, n_words), one for every row of
    docs, repeated ids and nulls included. The others are inverted lists: (shard, term, postings),
    positions as differences of 32-bit numbers; the empty term lists where documents start."""
    kind = docs.select(column(key)).schema[0].dataType.simpleString()
    rows = docs.select(
        column(key).alias("doc"), column("text").cast("string").alias("text")).mapInArrow(
        _index, f"shard long, term string, postings binary, doc {kind}, slot int, n_words long")
    return write_stage(rows, "positional-index")


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple]:
    """Runs of `size` words; fewer words are one window, none none."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def phrase_starts(lists: dict[bytes, np.ndarray], window: tuple) -> np.ndarray:
    """Positions where the window's words follow each other, by intersecting from the rarest."""
    order = sorted(range(len(window)), key=lambda i: len(lists[window[i]]))
    starts = lists[window[order[0]]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        known = lists[window[i]]
        at = np.searchsorted(known, starts + i)
        at[at == len(known)] = 0
        starts = starts[known[at] == starts + i]
    return starts


def near_positions(lists: dict[bytes, np.ndarray], window: tuple, slop: int) -> np.ndarray:
    """Positions of the window's rarest word with all its other words within `slop` positions,
    in any order; documents lie further apart than that."""
    order = sorted(set(window), key=lambda w: (len(lists[w]), w))
    found = lists[order[0]]
    for word in order[1:]:
        if not len(found):
            break
        known = lists[word]
        at = np.searchsorted(known, found - slop)
        found = found[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] <= found + slop)]
    return found


def _searcher(items: list[tuple], slop: int):
    """The search of one shard for a block of items (number, windows)."""

    def run(key, frame):
        return _search(key[0], frame, items, slop)

    return run


def _search(shard: int, frame: pd.DataFrame, items: list[tuple], slop: int) -> pd.DataFrame:
    """All matches of a block of items in one shard."""
    lists = {term.encode(): np.cumsum(np.frombuffer(data, "<i4"), dtype=np.int64)
             for term, data in zip(frame["term"], frame["postings"], strict=True)}
    starts = lists.pop(b"")
    rows = []
    for item, windows in items:
        spans: dict[int, list] = defaultdict(list)
        near: set[int] = set()
        for window in windows:
            if all(word in lists for word in window):
                at = phrase_starts(lists, window)
                slots = np.searchsorted(starts, at, "right") - 1
                for slot, start in zip(slots.tolist(), (at - starts[slots]).tolist(), strict=True):
                    spans[slot].append((start, start + len(window)))
                close = near_positions(lists, window, slop)
                near.update((np.searchsorted(starts, close, "right") - 1).tolist())
        for slot, found in spans.items():
            merged: list[list[int]] = []
            for start, end in sorted(found):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            rows.append((shard, slot, item, True, [{"start": a, "end": b} for a, b in merged]))
        rows += [(shard, slot, item, False, []) for slot in near]
    return pd.DataFrame(rows, columns=["shard", "slot", "item", "exact", "spans"])


def item_pieces(benchmark: DataFrame, size: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(digest, at, text): the distinct texts of benchmark, cut into pieces that begin every
    `piece` words and reach `size` - 1 words into the next, so that each window is in one piece
    whole. A text of fewer words than a window is one piece; one without words is none."""
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    return (
        benchmark.select(F.coalesce(column("text").cast("string"), F.lit("")).alias("text"))
        .groupBy(F.md5("text").alias("digest")).agg(F.first("text").alias("text"))
        .select("digest", words.alias("words")).where(F.size("words") > 0)
        .select("digest", "words", F.explode(F.sequence(F.lit(0), last, F.lit(piece))).alias("at"))
        .select("digest", "at", F.array_join(
            F.slice("words", F.col("at") + 1, piece + size - 1), " ").alias("text"))
    )


def search(index: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 20) -> DataFrame:
    """Matches of benchmark items (item_id, text) in a stored index.

    (shard, slot, item_id, exact, spans): exact rows carry the merged word spans [start, end) of
    all windows of `size` words that occur, per piece of the item; the others say that all words of
    a window are within `slop` positions of its rarest word (exact ones included). Items without
    words match nothing. Equal texts are searched once; null item ids are ids like others.

    The items are taken in blocks of about WORDS_PER_BLOCK words, made of pieces of PIECE words at
    most, so a very long item is in several. A block's matches are written before the next begins:
    the driver and each task hold one block, and the number of passes follows the benchmark."""
    spark = index.sparkSession
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    named = benchmark.select(
        column("item_id").alias("item_id"),
        F.md5(F.coalesce(column("text").cast("string"), F.lit(""))).alias("digest")).distinct()
    pieces = write_stage(item_pieces(benchmark, size), "pieces")
    total = pieces.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = -(-total // WORDS_PER_BLOCK)
    parts = [spark.createDataFrame(
        [], "digest string, shard long, slot int, exact boolean, spans array<struct<start:int,end:int>>")]
    for block in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("digest", "at"), F.lit(blocks)) == block).collect()
        wanted = [(i, windows_of(words_of(row.text), size)) for i, row in enumerate(rows)]
        terms = sorted({word.decode() for _, windows in wanted for w in windows for word in w})
        # at most WORDS_PER_BLOCK words, and one row per piece
        names = spark.createDataFrame([("",), *[(t,) for t in terms]], "term string")
        numbered = spark.createDataFrame(
            [(i, row.digest) for i, row in enumerate(rows)], "item long, digest string")
        found = (
            index.where("term is not null").join(F.broadcast(names), "term")
            .select("shard", "term", "postings").groupBy("shard")
            .applyInPandas(_searcher(wanted, slop), FOUND)
        )
        parts.append(write_stage(
            found.join(F.broadcast(numbered), "item").select(parts[0].columns), "block-matches"))
    matches = functools.reduce(DataFrame.unionAll, parts)
    return matches.join(named, "digest").select("shard", "slot", "item_id", "exact", "spans")


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per indexed document: doc, n_words, n_hit (words inside any matching window), n_items,
    item_ids (sorted as strings), n_near_items. Null item ids count as one item, without a name."""
    matches = write_stage(matches, "matches")
    covered = F.aggregate(
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("exact"), F.col("spans"))))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], done["to"])))
            .alias("n"), F.greatest(done["to"], s["end"]).alias("to")),
        lambda done: done["n"])
    named = F.col("item_id").cast("string")
    hits = matches.groupBy("shard", "slot").agg(
        covered.alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), named))).alias("item_ids"),
        F.max((F.col("exact") & named.isNull()).cast("int")).alias("unnamed"),
        F.size(F.collect_set(F.when(~F.col("exact"), named))).cast("long").alias("n_near_items"))
    docs = index.where("term is null").select("shard", "slot", "doc", "n_words")
    none = F.array().cast("array<string>")
    return docs.join(hits, ["shard", "slot"], "left").select(
        "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        (F.size(F.coalesce("item_ids", none)) + F.coalesce("unnamed", F.lit(0))).cast("long")
        .alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents in which a window of any item occurs, columns as they are,
    whatever their names. Whether one occurs follows from the text alone, so equal texts share
    their fate; null and empty texts have no words and stay, and so do repeated rows. Items without
    words match nothing; an empty table of either kind removes nothing. Texts of any length are
    indexed whole."""
    digest = F.md5(F.coalesce(column("text").cast("string"), F.lit("")))
    index = build_index(
        docs.select(digest.alias("digest"), column("text").cast("string").alias("text")), "digest")
    found = search(index, benchmark).where("exact").select("shard", "slot").distinct()
    bad = index.where("term is null").join(found, ["shard", "slot"], "left_semi").select("doc").distinct()
    return without(docs, digest, write_stage(bad, "contaminated"))
