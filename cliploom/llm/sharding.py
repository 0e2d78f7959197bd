"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table whose size is prime:
slot = (offset + j * skip) mod size, offset and skip from the digest of its name. Shards take
turns, each claiming its first slot that is still free, until the table is full. A document goes
to the shard that owns slot (digest of its key mod size). Shards differ by one slot at most, and
adding or removing a shard moves little more than its own share of the documents.

The table has a fixed number of rows, whatever the data, so it is broadcast; placing a document
is one digest and one look-up, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import column, hex_number

#: Largest table that is broadcast: about 1 MB.
MAX_SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_slots(shards: list[str], slots: int) -> list[int]:
    """The owner (index into shards) of every slot; ValueError for unusable sizes."""
    if slots > MAX_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not 0 < len(shards) <= slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one and at most one per slot")
    at = [_number(f"{name}/offset") % slots for name in shards]
    step = [_number(f"{name}/skip") % (slots - 1) + 1 for name in shards]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + step[shard]) % slots
        owner[at[shard]] = shard
    return owner


def slot_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """Rows (slot, shard) of the filled table, one per slot."""
    owners = F.split(F.lit(",".join(map(str, fill_slots(shards, slots)))), ",").cast("array<int>")
    names = F.array(*[F.lit(name) for name in shards])
    return (
        spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
        .select("slot", F.element_at(names, F.col("owner") + 1).alias("shard"))
    )


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key; null counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (hex_number(F.md5(text)) % slots).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int, key: str = "doc_id") -> DataFrame:
    """docs with the columns slot and shard; columns of these names are replaced.

    Rows are neither lost nor added: every slot has an owner. Rows with equal keys (copies of an
    oversampled document, repeated rows, all null keys) share a shard. An empty table gives an
    empty result.
    """
    lookup = slot_table(docs.sparkSession, shards, slots)
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    row = F.struct(*[column(c).alias(c) for c in kept]).alias("row")
    slotted = docs.select(row, slot_of(column(key), slots).alias("slot"))
    # left join: the plan cannot drop a row
    return slotted.join(F.broadcast(lookup), "slot", "left").select("row.*", "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder per shard. Writers split a shard over several tasks, so that one with very
    many rows is not written by one task."""
    spread = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
