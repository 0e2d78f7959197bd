"""Spelling variants: words one letter apart, and the common form that a rare word stands for.

A word is a vector of bits, one for each letter and count ("a first e, a second e, ..."): its letter
multiset. A replaced letter changes two bits, an inserted or deleted one a single bit. The alphabet
is dealt into parts. Two bits spoil two parts at most, so words that differ by a replacement agree
in one of three parts; words that differ by an insertion agree in one of two. Each part is
enumerated as the one that stayed: its letters are a signature, and near words have an equal one.
That is exact; nothing is sampled.

A letter can change in one place only, so the half before it or the half after it stays letter by
letter. Signatures carry one of the two halves, and the length, which keeps their groups small:
anagrams and words of common letters do not meet. Pairs that meet are verified by edit distance,
and counted only at the first signature that they share.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import column
from cliploom.session import write_stage

#: Words have so many letters and stand so often in the corpus; a form is so many times as frequent.
LETTERS, TIMES, MORE = 7, 2, 10
#: One in so many words of a document loses a letter before counting.
DROPPED = 31
#: Parts of the alphabet: one more than can be spoilt by a replacement and by an insertion.
REPLACED, INSERTED = 3, 2
#: Fixed value: the letters by frequency of use, so that parts share the common ones.
ALPHABET = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))
_UPPER = {c: c + 32 for c in range(65, 91)}
_FLUSH = 400_000


def _counter(least: int, dropped: int):
    run_of = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}")  # greedy: a run is taken whole

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                begun = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for run, n in Counter(run_of.findall(text.as_py() or "")).items():
                    word = run.lower() if run.isascii() else run.translate(_UPPER)
                    h = zlib.crc32(word.encode(), begun)
                    if not h % dropped:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > _FLUSH:
                    yield rows()
                    total.clear()
        yield rows()

    return count


def count_words(docs: DataFrame, key: str = "doc_id", least: int = LETTERS, times: int = TIMES,
                dropped: int = DROPPED) -> DataFrame:
    """(word, n) of all words with `least` letters that stand `times` times in the texts."""
    rows = docs.select(column(key).cast("string").alias("doc"),
                       column("text").cast("string").alias("text"))
    return (
        rows.mapInArrow(_counter(least, dropped), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)
    )


def _part(word: Column, part: int, parts: int) -> Column:
    """The letters of a word that are in one part of the alphabet, sorted. Signs that are not in
    the alphabet are in every part; count_words makes none."""
    ordered = F.array_join(F.array_sort(F.split(word, "")), "")
    return F.translate(ordered, "".join(c for i, c in enumerate(ALPHABET) if i % parts != part), "")


def _halves(word: Column, grown: int) -> list[Column]:
    """The front and the back of a word, cut for a pair whose longer word has `grown` letters
    more than this one."""
    half = F.floor((F.length(word) + grown) / 2).cast("int")
    return [F.substring(word, F.lit(1), half), F.substring(word, half + 1 - grown, F.length(word))]


def _signed(words: DataFrame, parts: int, grown: int) -> DataFrame:
    """(key, sign, word): one row per word, part that may have stayed and half that may have."""
    word = F.col("word")
    signs = [
        F.xxhash64(F.length(word) + grown, F.lit(2 * part + side), _part(word, part, parts), half)
        for part in range(parts) for side, half in enumerate(_halves(word, grown))]
    return words.select("word", F.posexplode(F.array(*signs)).alias("sign", "key"))


def _met(longer: DataFrame, shorter: DataFrame, parts: int, grown: int) -> DataFrame:
    """(word, o_word): pairs with an equal signature that are one letter apart, each at the first
    signature that it has: the first part in which the words agree, and the front if they agree
    there. Keys are hashes; what meets by chance does not pass."""
    a, b = F.col("a.word"), F.col("b.word")
    same = F.lit(parts - 1)
    for part in reversed(range(parts - 1)):
        same = F.when(_part(a, part, parts) == _part(b, part, parts), part).otherwise(same)
    front = F.when(_halves(a, 0)[0] == _halves(b, grown)[0], 0).otherwise(1)
    return (
        longer.alias("a").join(shorter.alias("b"), F.col("a.key") == F.col("b.key"))
        .where((F.col("a.sign") == F.col("b.sign")) & (F.length(a) == F.length(b) + grown)
               & (F.levenshtein(a, b, 1) == 1) & (F.col("a.sign") == 2 * same + front))
        .select(a.alias("word"), b.alias("o_word"))
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, o_word): all words one inserted, deleted or replaced letter apart, each pair in both
    directions. words: distinct (word, n)."""
    same = _signed(words, REPLACED, 0)
    replaced = _met(same, same, REPLACED, 0)
    grown = _met(_signed(words, INSERTED, 0), _signed(words, INSERTED, 1), INSERTED, 1)
    both = F.array(F.struct("word", "o_word"),
                   F.struct(F.col("o_word").alias("word"), F.col("word").alias("o_word")))
    return replaced.unionAll(grown.select(F.explode(both).alias("p")).select("p.word", "p.o_word"))


def variants(words: DataFrame, more: int = MORE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. words: distinct (word, n).

    The form is the most frequent near word, the first in code-point order of equals, if it is
    `more` times as frequent as the word. The root is the end of the chain of forms. It cannot
    return to a word, since every form is more frequent."""
    known = words.select(F.col("word").alias("o_word"), F.col("n").alias("o_n"))
    near = near_pairs(words).join(known, "o_word").groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("o_n")).alias("n"), F.col("o_word").alias("word"))).alias("best"))
    common = -F.col("best.n") >= more * F.col("n")
    found = write_stage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(common, F.col("best.word")).alias("form"),
            F.when(common, -F.col("best.n")).alias("form_n")), "variants")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # every round doubles the reach; a form is ten times as frequent, so rounds are few
        further = roots.join(
            roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        roots = write_stage(
            further.select("word", F.coalesce("next", "root").alias("root"),
                           F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    return found.join(roots.select("word", "root"), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group_spellings(docs: DataFrame, key: str = "doc_id", least: int = LETTERS,
                    times: int = TIMES, dropped: int = DROPPED, more: int = MORE) -> DataFrame:
    """The words of docs with their variants; columns as in `variants`.

    Null and empty texts have no words; a null key counts as an empty one. Repeated rows are
    counted each. Texts of any length are read whole, one at a time. An empty table has no words.
    Further columns are ignored, whatever their names."""
    return variants(write_stage(count_words(docs, key, least, times, dropped), "words"), more)
