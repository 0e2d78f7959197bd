"""Quality rules by robust multivariate outliers.

Every document is a vector of transformed text statistics (log of the mean word length, arcsine
square roots of shares). For each stratum (language and source) the minimum covariance
determinant gives the centre and covariance of the three quarters of its documents that lie
closest together, and a document far from that centre in Mahalanobis distance is rejected.

The determinant is minimized by concentration steps on all rows, from two deterministic starts
(median and quartile scales; correlations of bounded scores). In each step the distances of a
stratum are binned; counts, sums and products of the vectors are added up per (stratum, bin) on
the map side, and the inner bins that hold the wanted share of rows give the next estimate. A
stratum with a third of all rows is thus a few hundred rows after the map side, and no step sorts
or gathers documents. Only the estimates, one small row per stratum and start, meet Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliploom.llm.common import column, without
from cliploom.llm.textstats import FIELDS, stats
from cliploom.session import write_stage

NAMES = ("word_length", "symbols", "marks", "upper", "digits", "repeats", "repeated_lines")
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: what fails outright. share: rows an estimate rests on.
    slack: how far a statistic may lie from the centre, as a standard deviation, even where it
    hardly varies. Each is below a limit-th of what its statistic can reach, so that each can
    reject a document alone: from a centre of 0, digits do from a quarter of the characters,
    repeated words from 43 % and repeated lines from 48 %. tail: share of a normal population
    beyond the limit. min_rows: strata with fewer rows are pooled by language, and then
    altogether; what is left is estimated together however few it is. steps, settled: concentration ends
    after so many steps, or when no determinant changes by more (as a logarithm)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    share: float = 0.75
    slack: tuple[float, ...] = (0.06, 0.04, 0.03, 0.03, 0.08, 0.11, 0.115)
    tail: float = 1e-6
    min_rows: int = 200
    steps: int = 12
    settled: float = 1e-2


def limit(rules: Rules) -> float:
    """The chi-squared quantile of the squared distance (Wilson and Hilferty's form)."""
    z = NormalDist().inv_cdf(1 - rules.tail)
    return P * (1 - 2 / (9 * P) + z * (2 / (9 * P)) ** 0.5) ** 3


MEDIAN = P * (1 - 2 / (9 * P)) ** 3


def failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def vector() -> list[Column]:
    """NAMES from the counts; shares of nothing are 0."""
    def share(part: str, whole: str) -> Column:
        ratio = F.col(part) / F.greatest(F.col(whole), F.lit(1))
        return F.asin(F.sqrt(F.least(ratio, F.lit(1.0))))

    length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    shares = [share("n_symbols", "word_chars"), share("n_marks", "word_chars"),
              share("n_upper", "word_chars"), share("n_digits", "word_chars"),
              share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")]
    return [c.alias(n) for n, c in zip(NAMES, [length, *shares], strict=True)]


def assign_strata(rows: DataFrame, min_rows: int) -> DataFrame:
    """(pair, stratum) for every (lang, source) that occurs: the pair itself if it has enough
    rows, else the rest of its language if that has, else the rest of all."""
    counts = write_stage(rows.groupBy("lang", "source").count(), "pairs")
    whole = F.col("count") >= min_rows
    language = F.col("lang").alias("of")
    pooled = counts.where(~whole).groupBy(language).agg(F.sum("count").alias("pooled"))
    level = F.when(whole, "source").when(F.col("pooled") >= min_rows, "language").otherwise("all")
    named = F.to_json(F.struct(
        "level", F.when(F.col("level") != "all", F.col("lang")).alias("lang"),
        F.when(F.col("level") == "source", F.col("source")).alias("source")))
    return (
        counts.join(pooled, F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("level", level)
        .select(F.struct("lang", "source").alias("pair"), named.alias("stratum"))
    )


def _whiten(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The lower triangle W with W (x - m) of unit covariance, and the log determinant."""
    factor = np.linalg.cholesky(cov)
    return np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())


def _estimate(slack: tuple[float, ...]):
    """Estimates from sums: one row (stratum, start) in, one row out."""
    ridge = np.diag(np.square(slack))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for stratum, start, n, was, sums, products in frame.itertuples(index=False):
                mean = np.asarray(sums) / n
                cov = np.zeros((P, P))
                for (i, j), value in zip(PAIRS, products, strict=True):
                    cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
                white, log_det = _whiten(cov + ridge)
                rows.append((stratum, start, mean, white[np.tril_indices(P)], log_det,
                             abs(log_det - was)))
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


COLUMNS = ["stratum", "start", "mean", "white", "log_det", "moved"]
ESTIMATE = ("stratum string, start int, mean array<double>, white array<double>, log_det double, "
            "moved double")


def _square() -> Column:
    """The squared Mahalanobis distance of the vector to its row's estimate."""
    parts = []
    for i in range(P):
        whitened = " + ".join(f"white[{k}] * ({NAMES[b]} - mean[{b}])"
                              for k, (a, b) in enumerate(PAIRS) if a == i)
        parts.append(f"pow({whitened}, 2)")
    return F.expr(" + ".join(parts))


def _sums() -> list[Column]:
    """The number of rows, and the sums and products of their vectors."""
    sums = ", ".join(f"sum({n})" for n in NAMES)
    products = ", ".join(f"sum({NAMES[i]} * {NAMES[j]})" for i, j in PAIRS)
    return [F.expr(e) for e in ("count(*) AS n", f"array({sums}) AS sums",
                                f"array({products}) AS products")]


def _binned(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Sums per (stratum, start, bin of distance), and the rows that lie further in."""
    near = rows.join(estimates.select("stratum", "start", "mean", "white", "log_det"), "stratum")
    at = F.floor(8 * F.log(F.greatest(_square(), F.lit(1e-9)))).alias("bin")
    sums = near.select("stratum", "start", "log_det", *NAMES, at).groupBy(
        "stratum", "start", "bin").agg(F.max("log_det").alias("log_det"), *_sums())
    inner = Window.partitionBy("stratum", "start").orderBy("bin")
    return sums.select(
        "*", F.coalesce(F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0)).alias("further_in"),
        F.sum("n").over(Window.partitionBy("stratum", "start")).alias("all_rows"))


def _added(sums: DataFrame) -> DataFrame:
    """One row per (stratum, start) from rows of sums."""
    def each(name: str, size: int) -> Column:
        return F.expr(f"array({', '.join(f'sum({name}[{i}])' for i in range(size))}) AS {name}")

    return sums.groupBy("stratum", "start").agg(
        F.sum("n").alias("n"), F.max("log_det").alias("was"), each("sums", P),
        each("products", len(PAIRS)))


def _starts(rows: DataFrame, rules: Rules) -> DataFrame:
    """Two estimates per stratum, around the medians: scales alone, and scales with the
    correlations of hyperbolic tangents of the scaled vectors."""
    quarters = F.array(*[F.percentile_approx(n, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 1000)
                         for n in NAMES])
    scaled = write_stage(rows.groupBy("stratum").agg(quarters.alias("q")), "quarters")
    bounded = rows.join(scaled, "stratum").select("stratum", F.lit(0).alias("start"), *[
        F.tanh((F.col(n) - F.col("q")[i][1])
               / ((F.col("q")[i][2] - F.col("q")[i][0]) / 1.349 + rules.slack[i])).alias(n)
        for i, n in enumerate(NAMES)])
    sums = bounded.groupBy("stratum", "start").agg(*_sums()).drop("start")
    slack = np.array(rules.slack)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for stratum, q, n, total, products in frame.itertuples(index=False):
                q = np.array([list(x) for x in q])
                scale = np.hypot((q[:, 2] - q[:, 0]) / 1.349, slack)
                cov = np.zeros((P, P))
                for (i, j), value in zip(PAIRS, products, strict=True):
                    cov[i, j] = cov[j, i] = value / n - total[i] * total[j] / n / n
                spread = np.sqrt(np.diag(cov)) + 1e-3
                correlation = 0.9 * cov / np.outer(spread, spread) + 0.1 * np.eye(P)
                np.fill_diagonal(correlation, 1.0)
                for start, matrix in enumerate((np.eye(P), correlation)):
                    white, log_det = _whiten(matrix * np.outer(scale, scale))
                    out.append((stratum, start, q[:, 1], white[np.tril_indices(P)], log_det, 0.0))
            yield pd.DataFrame(out, columns=COLUMNS)

    return scaled.join(sums, "stratum").mapInPandas(run, ESTIMATE)


@dataclass(frozen=True)
class Model:
    """strata: (pair, stratum). estimates: (stratum, mean, white, scale), tables of their own."""

    strata: DataFrame
    estimates: DataFrame


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """The counts, the vector, lang and source of every document, under these names alone
    (whatever else docs has), with the columns named in keep as keep_<name>."""
    counted = docs.select(
        *[column(c).alias(f"keep_{c}") for c in keep], column("lang").cast("string").alias("lang"),
        column("source").cast("string").alias("source"), stats(column("text")).alias("counts"))
    counted = counted.select(*[c for c in counted.columns if c != "counts"], "counts.*")
    return counted.select("*", *vector())


def fit(measured: DataFrame, rules: Rules = Rules()) -> Model:
    """Estimate every stratum from all measured rows that do not fail outright. Null languages and
    sources are values like others. Without such rows there are no estimates."""
    good = measured.where(~failed(rules)).select("lang", "source", *NAMES)
    strata = write_stage(assign_strata(good, rules.min_rows), "strata")
    rows = write_stage(
        good.withColumn("pair", F.struct("lang", "source")).join(strata, "pair")
        .select("stratum", *NAMES), "vectors")

    estimates = write_stage(_starts(rows, rules), "starts")
    for _ in range(rules.steps):
        inner = _binned(rows, estimates).where(F.col("further_in") < rules.share * F.col("all_rows"))
        estimates = write_stage(
            _added(inner).mapInPandas(_estimate(rules.slack), ESTIMATE), "estimates")
        moved = estimates.agg(F.max("moved")).first()[0]
        if moved is None or moved < rules.settled:
            break
    # distances are scaled so that the middle one is where the normal law has it
    middle = _binned(rows, estimates).where(F.col("further_in") < F.col("all_rows") / 2)
    scale = middle.groupBy("stratum", "start").agg(
        (F.exp((F.max("bin") + 0.5) / 8) / MEDIAN).alias("scale"))
    best = estimates.join(scale, ["stratum", "start"]).groupBy("stratum").agg(
        F.min_by(F.struct("mean", "white", F.greatest("scale", F.lit(1.0)).alias("scale")),
                 F.struct("log_det", "start")).alias("e"))
    return Model(strata, write_stage(best.select("stratum", "e.*"), "model"))


def judge(measured: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """measured with base_failed, distance (squared, null for rows that fail outright in
    a language and source where all do) and kept."""
    placed = measured.withColumn("pair", F.struct("lang", "source")).join(
        model.strata, "pair", "left").join(model.estimates, "stratum", "left")
    distance = _square() / F.col("scale")
    return (
        placed.withColumn("distance", distance).withColumn("base_failed", failed(rules))
        .withColumn("kept", ~F.col("base_failed") & (
            F.coalesce("distance", F.lit(0.0)) <= limit(rules)))
        .drop("pair", "stratum", "mean", "white", "scale")
    )


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rejected ones, columns as they are, whatever their names.

    A verdict follows from text, language and source alone, so the texts are measured once, in a
    slim table, and only the rejected (digest of text, language, source) meet the documents again.
    Rows that are equal in these share their verdict; repeated rows all stay or all go. Null and
    empty texts have no words and are rejected. Texts of any length are measured whole, one at a
    time. An empty table stays empty."""
    def key() -> list[Column]:
        return [F.md5(F.coalesce(column("text").cast("string"), F.lit(""))).alias("digest"),
                column("lang").cast("string").alias("lang"),
                column("source").cast("string").alias("source")]

    slim = docs.select(*key(), column("text").cast("string").alias("text"))
    measured = write_stage(measure(slim, "digest"), "measured")
    bad = judge(measured, fit(measured, rules), rules).where(~F.col("kept")).select(
        F.struct(F.col("keep_digest").alias("digest"), "lang", "source").alias("bad")).distinct()
    return without(docs, F.struct(*key()), write_stage(bad, "rejected"))
