"""Toxicity by the nearest labelled examples.

Terms are words and the first three, five and seven characters of longer words. A bounded sample of labelled
documents (Bounds.examples per class, those with the smallest digests of their ids) tells which
terms go with the label; only these span the space. Their document frequencies are counted over
all documents. Examples and documents are TF-IDF vectors of unit length; the score of a document
comes from the examples nearest by cosine.

The search is exact, over a block-max inverted index. Examples are sorted by their strongest terms
and cut into blocks; a block has inverted lists for its terms and the largest weight of each list.
The largest weights bound every similarity in a block. A document visits its most promising blocks
first and keeps the k-th similarity that it has found; blocks whose bound lies below are skipped.
Documents that visit a block together are compared by one product with its lists, in single
precision; what comes near the k-th similarity is computed again in double precision. The index is
bounded by the sample and goes to the tasks whole.

Votes are weighted by squared similarity and by how often a class is in the labels compared with
the sample. A logistic curve fitted to leave-one-out votes of the examples makes them calibrated.
A document without any of the terms gets the toxic share of examples without any.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import column
from cliploom.session import write_stage

PREFIXES = (3, 5, 7)
#: Examples of a block, and blocks that a document visits before it skips any.
BLOCK, FIRST = 64, 2
#: More than sums of single precision are off.
ROUNDING = 1e-4
#: ASCII characters that are not letters become spaces; words are then split at white space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Bounds:
    """examples: labelled documents of each class that are learnt from. min_docs: examples a term
    must occur in. neighbours: k. block: documents that are compared with the examples at once."""

    examples: int = 10_000
    min_docs: int = 3
    neighbours: int = 16
    block: int = 256


def held_out(doc_id: Column) -> Column:
    """True for a fifth of the ids; null counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def terms_of(text: str | None) -> Counter:
    """Terms of a text and how often each occurs; prefixes end in an asterisk."""
    words = Counter((text or "").lower().encode().translate(_LETTERS).decode().split())
    for word, n in list(words.items()):
        for length in PREFIXES:
            if len(word) > length:
                words[word[:length] + "*"] += n
    return words


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the ids outside the held-out fifth, one row each: repeated label rows
    count once, and an id with both labels is toxic. Null ids and labels are left out."""
    return (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where(~held_out(F.col("doc_id")))
    )


def example_labels(labels: DataFrame, per_class: int) -> DataFrame:
    """(example_id, toxic) of the sample: of each class the ids with the smallest digests."""
    known = known_labels(labels).select(
        F.col("doc_id").alias("example_id"), "toxic",
        F.md5(F.col("doc_id").cast("string")).alias("draw"))
    parts = [known.where(F.col("toxic") == c).orderBy("draw").limit(per_class) for c in (0, 1)]
    return write_stage(parts[0].union(parts[1]).drop("draw"), "examples")


def _count_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            for term in terms_of(text):
                counts[term][toxic] += 1
        yield pd.DataFrame([(t, *n) for t, n in counts.items()],
                           columns=["term", "clean", "toxic"])


def _count_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term, added up in the task: the vocabulary bounds the rows of a batch."""
    for frame in frames:
        ids, n = np.unique(np.concatenate([np.empty(0, np.int32), *frame["ids"]]), return_counts=True)
        yield pd.DataFrame({"id": ids.astype(np.int32), "n": n})


def choose_terms(texts: DataFrame, bounds: Bounds) -> list[str]:
    """All terms that go with either label more than chance explains: chi-squared above twice
    the logarithm of the number of terms tried, the strongest first, ties by term. The sample
    bounds their number."""
    counts = write_stage(
        texts.mapInPandas(_count_terms, "term string, clean long, toxic long")
        .groupBy("term").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
        .where(F.col("a") + F.col("b") >= bounds.min_docs), "terms")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    tried = counts.count()
    if not tried or len(sizes) < 2:
        return []
    n0, n1 = float(sizes[0]), float(sizes[1])
    a, b = F.col("a"), F.col("b")
    found = a + b
    square = (n0 + n1) * F.pow(a * n0 - b * n1, 2) / (
        n0 * n1 * found * F.greatest(n0 + n1 - found, F.lit(1.0)))
    rows = counts.select("term", square.alias("square")).where(
        F.col("square") > 2 * math.log(tried)).orderBy(F.desc("square"), "term")
    return [r.term for r in rows.collect()]


def _vectorizer(terms: list[str]):
    places = {term: i for i, term in enumerate(terms)}

    @F.pandas_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                                T.StructField("tfs", T.ArrayType(T.IntegerType()))]))
    def vectors(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = terms_of(text)
            own = sorted((places[t], found[t]) for t in found.keys() & places.keys())
            rows.append(([i for i, _ in own], [n for _, n in own]))
        return pd.DataFrame(rows, columns=["ids", "tfs"])

    return vectors


@dataclass
class Index:
    """Distinct example vectors, with the examples' labels counted per vector. block: queries
    that are compared at once."""

    idf: np.ndarray
    k: int
    block: int
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    votes: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))
    names: list = field(default_factory=list)
    #: Pairs of a query and a block so far, and those of them that were compared.
    asked: int = 0
    visited: int = 0

    def unit(self, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(tfs)) * self.idf[ids]
        return weights / np.sqrt((weights * weights).sum())

    @classmethod
    def build(cls, idf: np.ndarray, examples: list[tuple], k: int, block: int) -> Index:
        """examples: (ids, tfs, toxic, example id). Equal vectors are one entry."""
        index = cls(idf, k, block)
        merged: dict[tuple, tuple[list, list]] = {}
        for ids, tfs, toxic, name in sorted(examples, key=lambda e: (str(e[3]))):
            votes, names = merged.setdefault((tuple(ids), tuple(tfs)), ([0, 0], []))
            votes[toxic] += 1
            names.append(name)
        rows = []
        for (ids, tfs), (votes, names) in merged.items():
            ids = np.array(ids, np.int32)
            weights = index.unit(ids, np.array(tfs))
            rows.append((tuple(ids[np.argsort(-weights, kind="stable")]), ids, weights, votes,
                         names[0]))
        rows.sort(key=lambda r: (r[0], str(r[4])))
        if rows:
            index.ids = np.concatenate([r[1] for r in rows])
            index.weights = np.concatenate([r[2] for r in rows])
            index.ends = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])])
            index.votes = np.array([r[3] for r in rows], float)
            index.names = [r[4] for r in rows]
        return index

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "_blocks"}

    @cached_property
    def _blocks(self) -> tuple:
        """Made in the task: per block its entries, terms and lists (term, entry), and the largest
        weights (term, block)."""
        made = []
        largest = np.zeros((len(self.idf), -(-len(self.names) // BLOCK)), np.float32)
        for number, begin in enumerate(range(0, len(self.names), BLOCK)):
            end = min(begin + BLOCK, len(self.names))
            own = slice(self.ends[begin], self.ends[end])
            entries = np.repeat(np.arange(end - begin), np.diff(self.ends[begin:end + 1]))
            terms, places = np.unique(self.ids[own], return_inverse=True)
            lists = np.zeros((len(terms), end - begin), np.float32)
            lists[places, entries] = self.weights[own]
            largest[terms, number] = lists.max(axis=1)
            made.append((slice(begin, end), terms, lists))
        return made, largest

    def _exact(self, entries: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Similarities of entries to a query laid out over all terms."""
        sizes = self.ends[entries + 1] - self.ends[entries]
        begun = np.cumsum(sizes) - sizes
        at = np.repeat(self.ends[entries] - begun, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(self.weights[at] * dense[self.ids[at]], begun)

    def _nearest_of(self, entries: np.ndarray, values: np.ndarray, own: int | None):
        """Of these, the k nearest examples with all that tie with the last; its similarity, or
        0 if there are fewer than k."""
        if len(values) > 4 * self.k:
            # every entry is an example at least, so the k-th is among the k + 1 best entries
            near = values >= np.partition(values, -self.k - 1)[-self.k - 1] - 1e-12
            entries, values = entries[near], values[near]
        order = np.lexsort((entries, -values))
        entries, values = entries[order], values[order]
        counts = self.votes[entries].sum(axis=1)
        if own is not None and len(values) and values[0] > 1 - 1e-9:
            counts[0] -= 1
        reached = np.cumsum(counts)
        if not len(reached) or reached[-1] < self.k:
            return entries, values, 0.0
        last = values[np.searchsorted(reached, self.k)]
        near = values >= last - 1e-12
        return entries[near], values[near], last

    def _visit(self, left: np.ndarray) -> np.ndarray:
        """Similarities (query, entry) in single precision; 0 in blocks that a query skipped."""
        blocks, largest = self._blocks
        bounds = left @ largest + ROUNDING
        near = np.zeros((len(left), len(self.names)), np.float32)
        # the best so far: every entry is an example at least, and one may be the query itself
        best = np.zeros((len(left), self.k + 1), np.float32)
        promising = np.zeros(bounds.shape, bool)
        first = np.argsort(-bounds, axis=1)[:, :FIRST]
        np.put_along_axis(promising, first, True, axis=1)
        for visited in (promising, ~promising):
            for number in np.argsort(-bounds.max(axis=0, initial=0)):
                within, terms, lists = blocks[number]
                own = visited[:, number] & (bounds[:, number] > ROUNDING) & (
                    bounds[:, number] >= best.min(axis=1))
                own = np.flatnonzero(own)
                if len(own):
                    found = left[np.ix_(own, terms)] @ lists
                    near[own, within] = found
                    best[own] = np.partition(
                        np.hstack([best[own], found]), found.shape[1], axis=1)[:, found.shape[1]:]
                self.visited += len(own)
        self.asked += bounds.size
        return near

    def _nearest_block(self, queries: list[tuple], owns: list) -> Iterator[tuple]:
        units = [self.unit(ids, tfs) for ids, tfs in queries]
        left = np.zeros((len(queries), len(self.idf)), np.float32)
        for row, (ids, _), unit in zip(left, queries, units, strict=True):
            row[ids] = unit
        near = self._visit(left)
        dense = np.zeros(len(self.idf))
        for row, (ids, _), unit, own in zip(near, queries, units, owns, strict=True):
            least = 0.0
            if len(row) > self.k:
                # every entry is an example at least, so the k-th is among the k + 1 best entries
                least = np.partition(row, -self.k - 1)[-self.k - 1] - ROUNDING
            found = np.flatnonzero((row > 0) & (row >= least))
            if not len(found):
                yield found, np.empty(0)
                continue
            dense[ids] = unit
            entries_near, values, _ = self._nearest_of(found, self._exact(found, dense), own)
            dense[ids] = 0
            yield entries_near, values

    def nearest_all(self, queries: list[tuple], owns: list | None = None) -> Iterator[tuple]:
        """For every query (ids, tfs) the entries and similarities of the k nearest examples, and
        all that tie with the last. owns: the label of an example that is itself the query and
        does not count, or None."""
        owns = owns or [None] * len(queries)
        for at in range(0, len(queries), self.block):
            yield from self._nearest_block(queries[at:at + self.block], owns[at:at + self.block])

    def nearest(self, ids: np.ndarray, tfs: np.ndarray, own: int | None = None):
        return next(self.nearest_all([(ids, tfs)], [own]))


@dataclass
class Votes:
    """How votes become scores: prior is the toxic share of all labels, lift the weight of a
    clean and a toxic example, slope and offset the logistic curve, none the score of a document
    without terms."""

    prior: float
    lift: tuple[float, float]
    none: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, index: Index, queries: list[tuple], owns: list | None = None) -> Iterator[tuple]:
        """The toxic share of the votes, entries and similarities for every query (ids, tfs)."""
        queries = [(np.array(ids, np.int32), np.array(tfs, float)) for ids, tfs in queries]
        owns = owns or [None] * len(queries)
        for (entries, values), own in zip(index.nearest_all(queries, owns), owns, strict=True):
            votes = index.votes[entries].copy()
            if own is not None and len(values) and values[0] > 1 - 1e-9:
                votes[0, own] -= 1
            weighed = (votes * np.array(self.lift) * np.square(values)[:, None]).sum(axis=0)
            share = (weighed[1] + 0.5 * self.prior) / (weighed.sum() + 0.5)
            yield min(max(share, 1e-4), 1 - 1e-4), entries, values

    def score(self, share: float) -> float:
        odds = math.log(share / (1 - share))
        return 1 / (1 + math.exp(-(self.slope * odds + self.offset)))


def fit_logistic(odds: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's steps, with a small pull towards (1, 0)."""
    beta, at = np.array([1.0, 0.0]), np.column_stack([odds, np.ones_like(odds)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ beta, -30, 30)))
        slope = at.T @ (weight * (toxic - p)) - (beta - [1.0, 0.0])
        bend = (at * (weight * p * (1 - p))[:, None]).T @ at + np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


SCORE = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("similarity", T.ArrayType(T.DoubleType()))])


def _scorer(index: Index, votes: Votes, shown: int = 3):
    @F.pandas_udf(SCORE)
    def score(ids: pd.Series, tfs: pd.Series) -> pd.DataFrame:
        keys = [(tuple(i), tuple(n)) for i, n in zip(ids, tfs, strict=True)]
        asked = [key for key in dict.fromkeys(keys) if key[0]]
        known: dict[tuple, tuple] = {((), ()): (votes.none, [], [])}
        for key, (share, entries, values) in zip(asked, votes.raw(index, asked), strict=True):
            known[key] = (votes.score(share), [str(index.names[e]) for e in entries[:shown]],
                          values[:shown].tolist())
        rows = [known[key] for key in keys]
        return pd.DataFrame(rows, columns=["score", "evidence", "similarity"])

    return score


def _leave_one_out(index: Index, votes: Votes):
    @F.pandas_udf(T.DoubleType())
    def share(ids: pd.Series, tfs: pd.Series, toxic: pd.Series) -> pd.Series:
        found = votes.raw(index, list(zip(ids, tfs, strict=True)), [int(t) for t in toxic])
        return pd.Series([share for share, _, _ in found], dtype="float64")

    return share


def score_documents(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (ids of the nearest
    examples as strings), similarity.

    Null and empty texts have no terms. Rows with one id are scored each by its own text; an id
    that is an example is scored like any other document, itself among its neighbours, and stands
    for its first text in code-point order if it has several. Ties in similarity all vote. Texts of
    any length are read whole, one at a time. Without labels of both classes every score is the
    toxic share of the labels (0.5 without any). An empty table gives an empty result. Further
    columns are ignored, whatever their names."""
    docs = docs.select(column("doc_id").alias("doc_id"), column("text").cast("string").alias("text"))
    known = write_stage(known_labels(labels.select(
        column("doc_id").alias("doc_id"), column("toxic").alias("toxic"))), "labels")
    chosen = example_labels(known, bounds.examples)
    # one text per sampled id, so 2 * bounds.examples rows at most
    texts = write_stage(
        docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["example_id"])
        .groupBy("example_id", "toxic").agg(F.min("text").alias("text")), "example-texts")
    terms = choose_terms(texts, bounds)
    vector = _vectorizer(terms)("text")
    slim = write_stage(docs.select("doc_id", vector.alias("v")).select("doc_id", "v.*"), "vectors")

    n_docs = slim.count()
    df = np.zeros(len(terms))
    counted = slim.select("ids").mapInPandas(_count_ids, "id int, n long")
    for row in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():
        df[row.id] = row.n
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    taken = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    lift = tuple(sizes.get(c, 0) / taken[c] if taken.get(c) else 0.0 for c in (0, 1))
    votes = Votes(prior, lift, none=prior)

    examples = write_stage(
        texts.select("example_id", "toxic", vector.alias("v")).select("example_id", "toxic", "v.*"),
        "example-vectors")
    # the sample is bounded by its number, a vector by the vocabulary
    held = [(r.ids, r.tfs, r.toxic, r.example_id) for r in examples.where(F.size("ids") > 0).collect()]
    index = Index.build(idf, held, bounds.neighbours, bounds.block)
    bare = {r.toxic: r["count"] for r in
            examples.where(F.size("ids") == 0).groupBy("toxic").count().collect()}
    weighed = [bare.get(c, 0) * lift[c] for c in (0, 1)]
    votes.none = (weighed[1] + prior) / (sum(weighed) + 1)
    tried = examples.where(F.size("ids") > 0).select(
        _leave_one_out(index, votes)("ids", "tfs", "toxic").alias("share"), "toxic").collect()
    if tried and prior not in (0, 1):
        share = np.array([r.share for r in tried])
        toxic = np.array([r.toxic for r in tried], float)
        votes.slope, votes.offset = fit_logistic(
            np.log(share / (1 - share)), toxic, np.array(lift)[toxic.astype(int)])

    # vectors are small and searches are not: more tasks than the vectors' bytes ask for
    spread = slim.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism)
    scored = spread.select("doc_id", _scorer(index, votes)("ids", "tfs").alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.*").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
