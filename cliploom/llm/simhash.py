"""Near-duplicate documents by SimHash, linked through the anchors of a covering code.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their
halves. In each half the anchors are a covering code of radius 1: the perfect Hamming code of
length 31 for 31 bits, and the last bit as it is. The home of a half is the anchor that covers it;
its guests are all anchors that cover some half within 1 bit of it, that is, all within covering
radius plus threshold: 17 at most. If the halves of x and y differ in 1 bit at most, y is a guest
at x's home. So each fingerprint goes to 34 anchors at most, out of 2^33, and at each anchor the
fingerprints at home are compared with the guests.

Equal fingerprints are one row from the start. Anchors where nobody can meet are left out before
any comparison. The members of an anchor with many are dealt into a grid of cells of bounded size
(block of homes x block of guests), which together make every comparison. A cell returns a
spanning forest of its links, never all pairs, and connected components join the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliploom.llm.common import column, components, only
from cliploom.session import write_stage

SHINGLE, SEED, THRESHOLD = 3, 42, 3
#: Members of an anchor that are compared in one cell.
CELL = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number; 0 for null or no words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text takes no more memory
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _bit(position: Column) -> Column:
    """The bit of a position counted from 1; no bit for 0."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))
    return F.when(position > 0, one).otherwise(F.lit(0).cast("long"))


def _half_anchors(fp: Column, half: int) -> Column:
    bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    code, free = bits.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(bits, 31)
    # the syndrome: the exclusive or of the positions (from 1) of all set bits
    masks = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]
    syndrome = sum((F.bit_count(code.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
                   for k, mask in enumerate(masks)).cast("int")

    def anchor(word: Column, flag: Column, home: bool) -> Column:
        number = word + F.shiftleft(flag, 31) + F.lit(half << 32)
        return F.struct(number.alias("anchor"), F.lit(home).alias("home"))

    def beyond(i: Column) -> Column:
        """The word that covers the code with bit i turned."""
        return anchor(code.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome))), free,
                      False)

    home = code.bitwiseXOR(_bit(syndrome))
    # turning i or i xor syndrome leads to the same word; the syndrome itself leads home
    turned = F.filter(F.sequence(F.lit(1), F.lit(31)),
                      lambda i: (i != syndrome) & (i < i.bitwiseXOR(syndrome)))
    own = F.array(anchor(home, free, True), anchor(home, 1 - free, False))
    return F.concat(own, F.transform(turned, beyond))


def _anchors(fp: Column) -> Column:
    """The anchors of a fingerprint: array of (anchor, home)."""
    return F.concat(_half_anchors(fp, 0), _half_anchors(fp, 1))


def forest(homes: np.ndarray, guests: np.ndarray) -> list[tuple[int, int]]:
    """Links (home, guest) within the threshold that connect all that such links connect."""
    members = np.unique(np.concatenate([homes, guests]))
    label = np.arange(len(members))
    at_guest = np.searchsorted(members, guests)
    links = []
    for home, own in zip(homes, np.searchsorted(members, homes), strict=True):
        near = at_guest[np.bitwise_count((guests ^ home).view(np.uint64)) <= THRESHOLD]
        others = near[label[near] != label[own]]
        while len(others):
            links.append((int(home), int(members[others[0]])))
            label[label == label[others[0]]] = label[own]
            others = others[label[others] != label[own]]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, cell), home ones with role true; one cell in memory at a time."""
    held: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> list[tuple[int, int]]:
        homes, guests = rows[rows[:, 3] == 1, 2], rows[rows[:, 3] == 0, 2]
        return forest(np.unique(homes), np.unique(guests))

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        rows = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                                for n in ("anchor", "cell", "fp", "role")])
        if not len(rows):
            continue
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            cuts = np.concatenate([[0], cuts])
        parts = np.split(rows, cuts)
        links: list[tuple[int, int]] = []
        for part in parts[:-1]:
            held.append(part)
            links += settle(np.concatenate(held))
            held = []
        held.append(parts[-1])
        yield batch_of(links)
    if held:
        yield batch_of(settle(np.concatenate(held)))


def link_fingerprints(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all fingerprints
    connected by differences of 3 bits or fewer."""
    rows = fps.select("fp", F.inline(_anchors(F.col("fp"))))
    met = write_stage(
        rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any_home"))
        .where("n > 1 and any_home")
        .select("anchor", F.ceil(F.col("n") / cell).cast("long").alias("blocks")), "anchors")
    rows = rows.join(met, "anchor")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    at_home = rows.where("home").withColumn("at", F.explode(every)).select(
        "anchor", (block * F.col("blocks") + F.col("at")).alias("cell"), "fp",
        F.lit(True).alias("role"))
    as_guest = rows.withColumn("at", F.explode(every)).select(
        "anchor", (F.col("at") * F.col("blocks") + block).alias("cell"), "fp",
        F.lit(False).alias("role"))
    dealt = at_home.unionByName(as_guest).repartition("anchor", "cell")
    return dealt.sortWithinPartitions("anchor", "cell").mapInArrow(_compare, "a long, b long")


def near_duplicates(fingerprinted: DataFrame) -> DataFrame:
    """(fp, root, first_id): for every fingerprint the root of its component (the smallest
    fingerprint, as a signed number) and the smallest doc_id of the component.

    fingerprinted: doc_id, fp. Rows with equal fingerprints are one class from the start, so
    groups of copies of any size add one row. Null ids are passed over (first_id is null where
    a component has no other). An empty table gives an empty result."""
    classes = write_stage(
        fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "classes")
    roots = components(write_stage(link_fingerprints(classes.select("fp")), "near"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("class_id").alias("first_id"))
    return rooted.join(first, "root").select("fp", "root", "first_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, and among rows of
    that id the one whose digest over all columns is smallest. Null texts have fingerprint 0, like
    texts without words. Columns are kept as they are, whatever their names.

    Texts are fingerprinted once, beside ids and digests of whole rows; only the digests of the
    rows that stay meet the documents again. Rows that are equal in every column are one row then:
    where a kept row is repeated, one of its copies is taken."""
    whole = F.md5(F.to_json(F.struct(*[column(c).alias(c) for c in docs.columns])))
    slim = write_stage(
        docs.select(column("doc_id").alias("doc_id"), whole.alias("digest"),
                    column("text").cast("string").alias("text"))
        .select("doc_id", "digest", fingerprints("text").alias("fp")), "fingerprints")
    rows = slim.groupBy("doc_id", "fp", "digest").agg(F.count("*").alias("n"))
    found = near_duplicates(slim.select("doc_id", "fp"))
    first = (
        write_stage(rows, "rows").join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("root").agg(F.min(F.struct("fp", "digest", "n")).alias("kept"))
    )
    keep = write_stage(first.select("kept.digest", "kept.n"), "kept")
    single = only(docs, whole, keep.where("n = 1").select("digest"))
    if keep.where("n > 1").isEmpty():
        return single
    repeated = only(docs, whole, keep.where("n > 1").select("digest"))
    row = F.struct(*[column(c).alias(c) for c in docs.columns])
    one = repeated.select(row.alias("row")).groupBy(F.md5(F.to_json("row")).alias("digest")).agg(
        F.first("row").alias("row"))
    return single.unionAll(one.select("row.*"))
