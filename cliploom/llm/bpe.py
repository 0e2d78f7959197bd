"""Byte-level BPE: whole texts to ids and back, by a lexicon of frequent words.

A word is what the cutting pattern takes at once; merges never cross it. The words of all
documents are counted, the ids of the most frequent are worked out once, and a minimal acyclic
transducer holds them (`lexicon.py`); it is one file in the shared folder, which Spark hands to
every executor and tasks map. Words that it does not hold are merged exactly. How many words it
holds changes the speed only, never an id.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import column
from cliploom.llm.lexicon import Lexicon, compile_lexicon
from cliploom.session import shared_folder, write_stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Most words of a lexicon: it is some 20 MB then, whatever the corpus.
LEXICON_WORDS = 500_000
#: Characters that a task cuts at a time, and words that it looks up at a time.
PART, LOOKED_UP = 1 << 20, 1 << 18
#: Words that a task remembers from one look-up to the next, and that are merged side by side.
REMEMBERED, MERGED = 200_000, 8_192
#: Words that a task counts before it passes them on, and documents that it returns at once.
COUNTED, ROWS = 200_000, 1_000
#: Words of more bytes are merged with a heap. No rank.
LONG, NONE = 100, 1 << 62
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _late() -> frozenset[str]:
    """Letters and numbers of a later Unicode version than the vocabulary's library knows, which
    takes them for other signs. Only what `unicodedata` has not assigned needs asking."""
    from tokenizers.pre_tokenizers import ByteLevel  # only the driver needs it

    known, theirs = regex.compile(r"\p{L}"), ByteLevel(add_prefix_space=False)
    numeric = regex.compile(r"\p{N}")

    def differs(c: str) -> bool:
        before = "a" if known.match(c) else "1" if numeric.match(c) else None
        return before is not None and len(theirs.pre_tokenize_str(before + c)) > 1

    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in every if unicodedata.category(c) == "Cn" and differs(c))


def _ranges(chars: frozenset[str]) -> str:
    found: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in found)


def _spelled() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 ones for
    themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """What tasks need of a vocabulary file; its size is fixed."""

    tokens: list[bytes]                       # of every id
    first: list[int]                          # id of every byte
    ranks: dict[tuple[int, int], int]         # of the pairs of ids that merge
    made: list[int]                           # id that the pair of a rank becomes
    control: dict[str, int]                   # control strings that texts may hold
    late: frozenset[str]

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        bytes_of = _spelled()
        ids = data["model"]["vocab"]
        control = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = [b""] * (max([*ids.values(), *control.values()]) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(map(bytes_of.__getitem__, text))
        for text, i in control.items():
            tokens[i] = text.encode()
        first = [ids[c] for c, _ in sorted(bytes_of.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        return Vocabulary(tokens, first, ranks, [ids[a + b] for a, b in pairs], control, _late())

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: the pair of lowest rank is merged, the leftmost of equals first,
        until no pair has a rank."""
        ids = [self.first[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank = self.ranks.get
        found = list(map(rank, zip(ids, ids[1:]), repeat(NONE)))
        while found:
            lowest = min(found)
            if lowest == NONE:
                break
            i = found.index(lowest)
            ids[i:i + 2] = [self.made[lowest]]
            del found[i]
            if i:
                found[i - 1] = rank((ids[i - 1], ids[i]), NONE)
            if i < len(found):
                found[i] = rank((ids[i], ids[i + 1]), NONE)
        return ids

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that merge as sorted numbers, and their ranks."""
        keys = np.array([a << 32 | b for a, b in self.ranks] or [-1], np.int64)
        order = np.argsort(keys)
        return keys[order], np.array(list(self.ranks.values()) or [NONE], np.int64)[order]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self._pairs
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What `merge` gives for many words that are not empty: their ids one after another, and
        how many each has. A step merges the lowest pair of every word that has one left."""
        parts = [self._side_by_side(words[i:i + MERGED]) for i in range(0, len(words), MERGED)]
        none = np.empty(0, np.int64)
        return (np.concatenate([none, *(ids for ids, _ in parts)]),
                np.concatenate([none, *(sizes for _, sizes in parts)]))

    def _side_by_side(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        done = []  # (words, how many ids each has, their ids)
        for i in np.flatnonzero(lengths > LONG).tolist():
            ids = np.array(self.merge(words[i]), np.int64)
            done.append((np.array([i]), np.array([len(ids)]), ids))
        open_words = np.flatnonzero(lengths <= LONG)
        sizes = lengths[open_words]
        letters = np.frombuffer(b"".join([words[i] for i in open_words.tolist()]), np.uint8)
        ids = np.array(self.first, np.int64)[letters]
        # the rank of an id and the next one of its word
        rank = np.full(len(ids), NONE)
        rank[:-1] = self._ranks_of(ids[:-1], ids[1:])
        rank[np.cumsum(sizes) - 1] = NONE
        made = np.array(self.made or [0], np.int64)
        while len(open_words):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, starts)
            left = lowest < NONE
            if not left.all():
                stays = np.repeat(left, sizes)
                done.append((open_words[~left], sizes[~left], ids[~stays]))
                open_words, sizes, lowest = open_words[left], sizes[left], lowest[left]
                ids, rank = ids[stays], rank[stays]
                if not len(open_words):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = hits[np.searchsorted(hits, starts)]  # the first of every word
            ids[at] = made[lowest]
            before, after, last = at > starts, at + 2 < starts + sizes, at + 1
            rank[at] = NONE
            rank[at[after]] = self._ranks_of(ids[at[after]], ids[at[after] + 2])
            rank[at[before] - 1] = self._ranks_of(ids[at[before] - 1], ids[at[before]])
            stays = np.ones(len(ids), bool)
            stays[last] = False
            ids, rank, sizes = ids[stays], rank[stays], sizes - 1
        which, sizes, ids = (np.concatenate(part) for part in zip(*done, strict=True))
        order = np.argsort(which)
        return _pick(ids, np.cumsum([0, *sizes]), order)[0], sizes[order]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with the pairs in a heap: n log n."""
        rank, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(rank(pair, NONE), i, pair) for i, pair in enumerate(zip(ids, ids[1:]))]
        heapq.heapify(waiting)
        while waiting:
            lowest, i, pair = heapq.heappop(waiting)
            if lowest == NONE:
                break
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.made[lowest], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n:
                    new = (ids[left], ids[right])
                    heapq.heappush(waiting, (rank(new, NONE), left, new))
        return [i for i in ids if i >= 0]


@functools.lru_cache(2)
def _quick(late: frozenset[str]) -> re.Pattern:
    """The cutting pattern for texts below U+10000, its classes written out sign by sign: late
    signs are neither letters nor numbers, and nothing else needs asking."""
    signs = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    letter, number, space = (
        _ranges(frozenset(regex.findall(kind, signs)) - (late if kind != r"\s" else frozenset()))
        for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        rf" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+"
        rf"|[{space}]+(?![^{space}])|[{space}]+")


class Cutter:
    """Cuts texts into words, part by part, so that a very long text is never a list at once."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        late = _ranges(vocabulary.late)
        self.late = vocabulary.late
        self.usual, self.quick = regex.compile(PATTERN), _quick(vocabulary.late)
        self.exact = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![{late}])\p{{L}})+| ?(?:(?![{late}])\p{{N}})+"
            rf"| ?(?:[^\s\p{{L}}\p{{N}}]|[{late}])+|\s+(?!\S)|\s+")
        self.control = regex.compile("(" + "|".join(map(regex.escape, vocabulary.control)) + ")")
        self.gap = regex.compile(r"(?<=\S)\s(?=\S)")

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of words; control strings are words of their own. A word never lies across a
        single white space between other characters, so parts end there."""
        for i, piece in enumerate(self.control.split(text)):
            if i % 2:
                yield [piece]
                continue
            begin = 0
            while begin < len(piece):
                gap = self.gap.search(piece, begin + PART)
                end = gap.start() if gap else len(piece)
                yield self._pattern(piece[begin:end]).findall(piece[begin:end])
                begin = end

    def _pattern(self, part: str) -> re.Pattern | regex.Pattern:
        if len(part.encode("utf-16-le", "surrogatepass")) == 2 * len(part):
            return self.quick
        return self.usual if self.late.isdisjoint(part) else self.exact


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (text.as_py() or "" for text in batch.column("text"))


def _counter(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = Cutter(vocabulary), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                ["word", "n"])

        for batch in batches:
            for text in _texts(batch):
                for words in cutter.parts(text):
                    counts.update(words)
                    if len(counts) > COUNTED:
                        yield rows()
                        counts.clear()
        yield rows()

    return run


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> DataFrame:
    """(word, n): the most frequent words of all texts, `most` at most. Words whose counts differ
    by under 5 % (one degree of 16 to a doubling) go in together or stay out together, so what
    reaches the driver is a count for each of a thousand degrees at most."""
    counts = write_stage(
        docs.select(column("text").cast("string").alias("text"))
        .mapInArrow(_counter(vocabulary), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    degree = F.floor(F.log2("n") * 16).cast("int")
    left, lowest = most, None
    for row in sorted(counts.groupBy(degree.alias("degree")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        lowest = row.degree
    return counts.where(F.lit(False) if lowest is None else degree >= lowest)


def publish_lexicon(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and have Spark hand it to every executor, later ones
    included. Returns the name under which tasks find it."""
    name = f"lexicon-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.makeQualified(
        path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), None).toString())
    return name


def _merger(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word.encode() for word in batch.column("word").to_pylist()]
            flat, sizes = vocabulary.merge_all(words)
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum([0, *sizes])).tolist()
            ids = [data[a:b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(ids, pa.binary())], ["word", "ids"])

    return run


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of docs. Tasks merge and sort them; `most` words at most pass
    by the driver, a part at a time, and it holds the automaton."""
    chosen = frequent_words(docs, vocabulary, most).where(~F.col("word").isin(*vocabulary.control))
    merged = write_stage(
        chosen.mapInArrow(_merger(vocabulary), "word binary, ids binary"), "lexicon")
    entries = ((bytes(row.word), bytes(row.ids)) for row in merged.orderBy("word").toLocalIterator())
    return publish_lexicon(docs.sparkSession, compile_lexicon(entries))


def _pick(flat: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of `codes` one after another, and where each ends. List i is flat[ends[i]:ends[i+1]]."""
    sizes = ends[codes + 1] - ends[codes]
    out = np.cumsum(sizes)
    at = np.repeat(ends[codes] - (out - sizes), sizes) + np.arange(out[-1] if len(out) else 0)
    return flat[at], out


class Encoder:
    """Looks words up in the lexicon and merges those that it does not hold, each distinct one once
    for as long as it is remembered."""

    def __init__(self, vocabulary: Vocabulary, path: str) -> None:
        self.vocabulary, self.lexicon, self.cutter = vocabulary, Lexicon(path), Cutter(vocabulary)
        self._forget()

    def _forget(self) -> None:
        """Words get a code as they come; `flat` and `ends` hold the ids of those looked up."""
        self.codes: dict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _look_up(self) -> None:
        """The ids of words that have a code but none yet."""
        words = [word.encode() for word in islice(self.codes, len(self.ends) - 1, None)]
        numbers = self.lexicon.numbers(words)
        for control, number in self.vocabulary.control.items():
            # a control string is one id, never merged; the lexicon has none
            code = self.codes.get(control, -1) - (len(self.ends) - 1)
            if code >= 0:
                numbers[code] = -2 - number
        known, unseen, control = (np.flatnonzero(x) for x in (numbers >= 0, numbers == -1, numbers < -1))
        flat, upto = _pick(self.lexicon.id_table, self.lexicon.ends, numbers[known])
        merged, lengths = self.vocabulary.merge_all([words[i] for i in unseen.tolist()])
        every = np.concatenate([flat, merged, -2 - numbers[control]]).astype("<u4")
        ends = np.cumsum(np.concatenate(
            [[0], np.diff(upto, prepend=0), lengths, np.ones(len(control), np.int64)]))
        place = np.empty(len(words), np.int64)
        place[np.concatenate([known, unseen, control])] = np.arange(len(words))
        flat, upto = _pick(every, ends, place)
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto])

    def encode(self, texts: Iterator[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers. About LOOKED_UP words are
        looked up together."""
        waiting: list[tuple[bool, np.ndarray]] = []  # (ends a text, its codes)
        begun: list[bytes] = []
        size = 0

        def flush() -> Iterator[bytes]:
            self._look_up()
            for last, part in waiting:
                begun.append(_pick(self.flat, self.ends, part)[0].tobytes())
                if last:
                    yield b"".join(begun)
                    begun.clear()
            waiting.clear()
            if len(self.codes) > REMEMBERED:
                self._forget()

        for text in texts:
            for words in self.cutter.parts(text):
                codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
                waiting.append((False, codes))
                size += len(words)
                if size >= LOOKED_UP:
                    yield from flush()
                    size = 0
            waiting.append((True, np.empty(0, np.int64)))
        yield from flush()


class Decoder:
    """From ids to texts. Bytes that are no UTF-8 become U+FFFD; numbers beyond the vocabulary
    have no text."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.known = len(tokens)
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum([0, *map(len, tokens), 0])

    def text(self, data: bytes) -> str:
        ids = np.minimum(np.frombuffer(data, "<u4"), self.known).astype(np.int64)
        return _pick(self.letters, self.ends, ids)[0].tobytes().decode("utf-8", "replace")


def _encoding(vocabulary: Vocabulary, name: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary, SparkFiles.get(name)), Decoder(vocabulary.tokens)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                some = batch.slice(begin, ROWS)
                ids = list(encoder.encode(_texts(some)))
                made = {"doc": some.column("doc"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    made["decoded"] = pa.array(map(decoder.text, ids), pa.string())
                yield pa.RecordBatch.from_pydict(made)

    return run


def encode(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY,
           most: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """(key, ids) of every row of docs: the ids of its whole text as little-endian 32-bit numbers.

    Null and empty texts have no ids. Repeated rows and null keys are encoded each. A control
    string in a text is its one id. Texts of any length are cut part by part (only a run without
    a single white space is one part). An empty table gives an empty result. Further columns are
    ignored, whatever their names. With `decoded` a column of that name holds what the ids are
    decoded to, as `decoder` does it, but by the task that has them: no second Python worker."""
    rows = docs.select(column(key).alias("doc"), column("text").cast("string").alias("text"))
    known = Vocabulary.read(vocabulary)
    name = build_lexicon(rows, known, most)
    kind = rows.schema["doc"].dataType.simpleString()
    more = ", decoded string" if decoded else ""
    return rows.mapInArrow(_encoding(known, name, decoded), f"doc {kind}, ids binary{more}"
                           ).withColumnRenamed("doc", key)


def decoder(vocabulary: str = VOCABULARY):
    """A column function from ids to text (`Decoder`); null stays null."""
    tokens = Vocabulary.read(vocabulary).tokens

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(Decoder(tokens).text, na_action="ignore")

    return decode
