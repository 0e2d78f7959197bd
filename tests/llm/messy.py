"""Documents with everything that may come: nulls, empty and very long texts, repeated rows, ties,
and further columns whose names an operator might use itself."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, "
          "size long, fp long, digest string, shard string, slot int, label int, row string, "
          "score double, `key` string, n_words string")
PROSE = " ".join(f"word{i % 37} of{i % 11} the{i % 5}" for i in range(60))


def documents(spark: SparkSession) -> DataFrame:
    texts = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, None),
        (4, " \n\t ", "de", "b"), (None, PROSE + " end", None, "b"), (None, None, None, None),
        (5, "one", "en", "b"), (6, "One", "en", "b"), (7, "é ü 漢字 " * 30, "fr", "b"),
        (8, PROSE * 400, "en", "a"), (9, PROSE.upper(), "en", None),
    ]
    rest = (7, False, -1, 5, "d", "s", 3, 1, "r", 0.5, "k", "n")
    return spark.createDataFrame([(*t, *rest) for t in texts], SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def fair_shares(sizes, weights, total, most):
    """Targets by rounds: share by weight, cut, share the excess again."""
    targets = dict.fromkeys(sizes, 0.0)
    open_ones, left = {s for s in sizes if sizes[s]}, total
    while open_ones and left > 1e-9:
        whole = sum(weights[s] for s in open_ones)
        for s in open_ones:
            targets[s] += left * weights[s] / whole
        left = 0.0
        for s in list(open_ones):
            if targets[s] >= most * sizes[s]:
                left += targets[s] - most * sizes[s]
                targets[s] = most * sizes[s]
                open_ones.discard(s)
    return targets
