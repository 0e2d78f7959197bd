"""WARC archives: one gzip member per record, written and read back in splits.

Writing goes through Spark's own text writer, so archives can be in any store Spark reaches. The
writer ends every row with a separator; here that is a zero byte, and each row is a gzip member
without its last byte, which is the top byte of the little-endian length and zero for records
under 16 MB. Larger records are followed by an empty member, which ends in a zero byte as well.
The files are thus plain concatenations of gzip members. (They must not be named .gz: Spark would
then unpack them itself, whole, in one task.)

Reading is splittable: every task scans its byte range for the gzip magic and gets the pieces
between two magics, those that start in its range being its own (Hadoop's rule for records). The
magic may also occur inside compressed data. A piece is taken for a member only if its header is
sound and what it unpacks to begins like a record; a member that is not complete at the end of
its piece goes on with the next. What does not add up inside one range (a member that a false
magic cuts at a range's end) is put aside as fragments, and those few are joined by file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom.llm.common import column
from cliploom.session import write_stage

MAGIC = b"\x1f\x8b\x08"
GZIP = 31  # zlib's window bits for a gzip member
FIRST = b"WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
          " refers_to long, payload binary")
FRAGMENT = "file string, block long, piece long, last boolean, bytes binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with record_type and refers_to.

    Of pages with equal payloads the one with the largest id is the response and the others
    revisit it. Rows that repeat the largest id are responses too. A null html is empty; a null
    id is smaller than any other. The largest ids are a table (one row per payload) written before
    pages meet it, so that both sides of the join are plain scans and adaptive execution splits a
    payload that a third of all pages share. Further columns are ignored, whatever their names; a
    payload is one value in its task, of any length that a value may have. An empty table gives an
    empty result."""
    named = pages.select(
        column("page_id").cast("long").alias("page_id"), column("url").cast("string").alias("url"),
        F.coalesce(column("html"), F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("digest", F.unhex(F.sha1("payload")))
    first = write_stage(
        named.groupBy("digest").agg(F.max("page_id").alias("first_id")), "first-copies")
    kept = F.col("page_id").eqNullSafe(F.col("first_id"))
    return named.join(first, "digest").select(
        "page_id", "url", "payload", F.when(kept, "response").otherwise("revisit")
        .alias("record_type"), F.when(~kept, F.col("first_id")).alias("refers_to"))


def _value(text: str) -> str:
    """A header value cannot hold line ends or other control characters."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str,
                 refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_value(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return packer.compress(data) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = [batch.column(n) for n in ("page_id", "url", "payload", "record_type",
                                             "refers_to")]
        for values in zip(*columns, strict=True):
            packed = member(record_bytes(*[v.as_py() for v in values]))
            if packed[-1]:
                packed += member(b"")
            rows.append(packed[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["member"])


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records, one archive per task."""
    (records.mapInArrow(_members, "member binary").select(F.col("member").cast("string"))
     .write.option("lineSep", "\0").text(path))


def parse_record(data: bytes) -> dict:
    """The fields of one unpacked record; ValueError if it is not one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(FIRST):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = re.fullmatch(r"<urn:page:(-?\d*)>", fields["WARC-Record-ID"])[1]
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("WARC-Refers-To", ""))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, length):
            raise ValueError("the payload does not match its digest or length")
    return {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"),
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": int(refers[1]) if refers else None,
            "payload": payload if kind == "response" else b""}


class Unpacker:
    """Feeds consecutive pieces; says for each whether it completed, continued or was refused."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.unpacked = b""
        self.stream = None

    def feed(self, piece: bytes) -> bytes | None:
        """The record that this piece completes, b"" for an empty member, None while more is
        needed; zlib.error if the piece cannot be (a part of) a member."""
        if self.stream is None:
            if len(piece) < 10 or piece[3] & 0xE0:
                raise zlib.error("no gzip header")
            self.stream, self.unpacked = zlib.decompressobj(GZIP), b""
        self.unpacked += self.stream.decompress(piece)
        if self.stream.eof:
            if self.stream.unused_data or self.unpacked and not self.unpacked.startswith(FIRST):
                raise zlib.error("no record")
            done, self.held, self.stream = self.unpacked, [], None
            return done
        if not self.unpacked.startswith(FIRST):
            raise zlib.error("does not begin like a record")
        self.held.append(piece)  # only what is accepted: a refused piece stays with the caller
        return None

    def drop(self) -> list[bytes]:
        """Give up the open member and return its pieces."""
        held, self.held, self.stream = self.held, [], None
        return held


def _rows(found: list[dict]) -> dict:
    return {name: [row[name] for row in found] for name in
            ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
             "payload")}


_RECORD_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                 pa.binary())
_FRAGMENT_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())


def _batch(found: list[dict], aside: list[tuple]) -> pa.RecordBatch:
    """Records and fragments in one table: whichever a row is not, is null."""
    n, m = len(found), len(aside)
    arrays = [pa.array(values + [None] * m, kind) for values, kind
              in zip(_rows(found).values(), _RECORD_TYPES, strict=True)]
    arrays += [pa.array([None] * n + [row[i] for row in aside], kind)
               for i, kind in enumerate(_FRAGMENT_TYPES)]
    names = [f.split()[0] for f in f"{RECORD}, {FRAGMENT}".split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of the byte ranges of one task, piece by piece."""
    where, number, open_from, reader = None, 0, 0, Unpacker()
    aside: list[tuple] = []

    def put_aside(last: bool) -> None:
        pieces = reader.drop()
        aside.extend((*where, open_from + i, last and i == len(pieces) - 1, p)
                     for i, p in enumerate(pieces))

    for batch in batches:
        found: list[dict] = []
        for file, block, value in zip(*[batch.column(n) for n in ("file", "block", "value")],
                                      strict=True):
            here, piece = (file.as_py(), block.as_py()), value.as_py()
            if here != where:
                if where is not None:
                    put_aside(True)
                where, number = here, 0
                if here[1] == 0 and not piece:
                    continue  # what stands before the first magic of a file: nothing
            piece = MAGIC + piece
            for fresh in (reader.stream is None, True):
                if fresh:
                    open_from = number
                try:
                    done = reader.feed(piece)
                except zlib.error:
                    put_aside(False)
                    if fresh:
                        aside.append((*where, number, False, piece))
                        break
                    continue  # not a part of the open member: a member of its own?
                if done:
                    found.append(parse_record(done))
                break
            number += 1
        yield _batch(found, aside)
        aside = []
    if where is not None:
        put_aside(True)
        yield _batch([], aside)


def _join_fragments(key, frame):
    """The members that fragments of one file add up to. Bytes that belong to no member are an
    error: the archive is damaged."""
    import pandas as pd

    frame = frame.sort_values(["block", "piece"])
    found, reader = [], Unpacker()
    for piece in frame["bytes"]:
        if reader.stream is None:
            reader.stream, reader.unpacked = zlib.decompressobj(GZIP), b""
        reader.unpacked += reader.stream.decompress(piece)
        if reader.stream.eof:
            found.append(parse_record(reader.unpacked))
            reader.stream = None
    if reader.stream is not None:
        raise ValueError(f"{key[0]}: a gzip member does not end")
    return pd.DataFrame(_rows(found))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, read in splits.

    Columns as in RECORD: payload is empty for revisits, payload_bytes and payload_digest are
    those of the full payload in both cases. An empty folder of archives gives no rows."""
    pieces = (
        spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
        .schema("value string").text(path)
        .select(F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.col("value").cast("binary").alias("value"))
    )
    scanned = pieces.mapInArrow(_scan, f"{RECORD}, {FRAGMENT}")
    names = [f.split()[0] for f in RECORD.split(", ")]
    whole = scanned.where("file is null").select(*names)
    joined = (
        scanned.where("file is not null").select("file", "block", "piece", "bytes")
        .groupBy("file").applyInPandas(_join_fragments, RECORD)
    )
    return whole.unionByName(joined)
