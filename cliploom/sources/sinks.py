"""Tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: Sequence[str], writers: int = 8) -> None:
    """Replace only the partitions present in ``df``; each write is all or nothing.

    Rows are first brought together by partition value plus a salt, so a large partition is
    written by up to ``writers`` tasks and a small one does not become many files.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(writers)))
    (
        salted.repartition(*by, "_salt").drop("_salt").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )
