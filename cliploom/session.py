"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import functools
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cliploom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a local session (tests, benchmarks)
    gets a private one; on a cluster that would be a different disk on every machine, so there
    it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.cliploom.folder", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-cliploom-", dir="/tmp")
        spark.conf.set("spark.cliploom.folder", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class FileState(NamedTuple):
    path: str
    size: int
    changed: int


def files_of(spark: SparkSession, *paths: str) -> list[FileState]:
    """Name, size and time of change of all files under some paths, whatever store they are in; a
    path that does not exist has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for name in paths:
        path = hadoop.Path(name)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            files = store.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                found.append(FileState(f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove folders of this library's own, in whatever store they are."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@functools.cache
def code_version() -> str:
    """A digest of this library's sources: other code makes other tables."""
    parts = sorted(Path(__file__).parent.rglob("*.py"))
    return hashlib.sha256(b"\0".join(p.read_bytes() for p in parts)).hexdigest()


def stage_table(spark: SparkSession, name: str, inputs: str, build: Callable[[], DataFrame]
                ) -> DataFrame:
    """A stage's table, stored under what it was made from (``inputs``, and the code). It is built
    only if no session has finished it before; every attempt has a folder of its own, and the mark
    that Spark writes last says that it is whole."""
    key = hashlib.sha256(f"{name}|{inputs}|{code_version()}".encode()).hexdigest()
    root = f"{shared_folder(spark)}/stages/{key}"
    done = [f.path for f in files_of(spark, root) if f.path.endswith(f"/{name}/_SUCCESS")]
    if not done:
        path = f"{root}/{uuid.uuid4().hex}/{name}"
        build().write.parquet(path, compression="zstd")
    else:
        path = done[0].removesuffix("/_SUCCESS")
    return spark.read.parquet(path)


def write_stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a stage's table to the shared folder and read it back: columnar, pruned, and
    independent of the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
