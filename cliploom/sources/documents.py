"""Bulk readers for recorded JSON documents.

A reader takes a column of document texts, from files or from a table, and splits it: every
document is accepted whole or set aside with the first thing wrong with it. Nothing is
repaired, migrated or partly salvaged.

What a document may hold is written down as a shape: names, kinds and nesting. Names and JSON
kinds are checked at every level before anything is read from it, so a number in quotes, a null,
a NaN or an extra field deep inside refuses the document. Rules about values come after.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliploom import rules
from cliploom.functions.columns import first_problem
from cliploom.functions.json import object_keys, shape_problem


#: A shape: "string", "int" or "number" (with ? if null will do); a dictionary of names (with ? if the field may be absent
#: or null) for an object; a list of one shape for a list; ("map", shape) for free names.
Shape = str | dict | list | tuple


@dataclass(frozen=True)
class Kind:
    """One kind of document: exact version, exact shape, and what else must hold."""

    version: int
    shape: dict
    rules: tuple[tuple[str, str], ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [name.rstrip("?") for name in self.shape]

    @property
    def required(self) -> list[str]:
        return [name for name in self.shape if not name.endswith("?")]


_DDL = {"string": "string", "int": "bigint", "number": "double"}
_JSON_KINDS = {"string": "STRING", "int": "BIGINT", "number": r"(BIGINT|DOUBLE|DECIMAL\(\d+,\s*\d+\))"}


def ddl(shape: Shape) -> str:
    """The Spark type that a shape is read into."""
    if isinstance(shape, str):
        return _DDL[shape.rstrip("?")]
    if isinstance(shape, list):
        return f"array<{ddl(shape[0])}>"
    if isinstance(shape, tuple):
        return f"map<string,{ddl(shape[1])}>"
    return f"struct<{','.join(f'`{n.rstrip('?')}`:{ddl(x)}' for n, x in shape.items())}>"


def fits(value: str, shape: Shape, depth: int = 0) -> str:
    """SQL: whether a VARIANT has exactly the names and kinds of a shape, at every level."""
    kind, item = f"schema_of_variant({value})", f"v{depth}"
    if isinstance(shape, str) and shape.endswith("?"):
        return f"({value} IS NULL OR is_variant_null({value}) OR {fits(value, shape[:-1], depth)})"
    if isinstance(shape, str):
        return f"{kind} RLIKE '^{_JSON_KINDS[shape]}$'".replace("\\", "\\\\")
    if isinstance(shape, list):
        return (f"(startswith({kind}, 'ARRAY') AND forall(variant_get({value}, '$', "
                f"'array<variant>'), {item} -> {fits(item, shape[0], depth + 1)}))")
    entries = f"variant_get({value}, '$', 'map<string,variant>')"
    if isinstance(shape, tuple):
        return (f"(startswith({kind}, 'OBJECT') AND forall(map_values({entries}), "
                f"{item} -> {fits(item, shape[1], depth + 1)}))")
    names = ", ".join(f"'{n.rstrip('?')}'" for n in shape)
    tests = [f"startswith({kind}, 'OBJECT')",
             f"size(array_except(map_keys({entries}), array({names}))) = 0"]
    for name, inner in shape.items():
        part = f"variant_get({value}, '$.{name.rstrip('?')}', 'variant')"
        test = f"coalesce({fits(part, inner, depth + 1)}, false)"
        if name.endswith("?"):
            test = f"({part} IS NULL OR is_variant_null({part}) OR {test})"
        tests.append(test)
    return f"({' AND '.join(tests)})"


def merged(shape: Shape) -> str:
    """The schemas that SCHEMA_OF_VARIANT may give for a value of a shape without free names: it
    joins those of all rows of a list, so it has every name and kind that occurs in any row."""
    if isinstance(shape, str):
        kind = _JSON_KINDS[shape.rstrip("?")]
        return f"(VOID|{kind})" if shape.endswith("?") else kind
    if isinstance(shape, list):
        return f"ARRAY<(VOID|{merged(shape[0])})>"
    parts = []
    for name, inner in sorted((n.rstrip("?"), (n, x)) for n, x in shape.items()):
        kind, absent = merged(inner[1]), inner[0].endswith("?")
        parts.append(f"({name}: {f'(VOID|{kind})' if absent else kind}(, |(?=>)))" + "?" * absent)
    return f"OBJECT<{''.join(parts)}>"


def lacks(value: str, shape: Shape, depth: int = 0) -> str:
    """SQL: whether a value read by its shape lacks something that is not optional, in any row."""
    item = f"l{depth}"
    tests = [f"{value} IS NULL"]
    if isinstance(shape, list):
        tests.append(f"exists({value}, {item} -> {lacks(item, shape[0], depth + 1)})")
    elif isinstance(shape, dict):
        for name, inner in shape.items():
            part, free = f"{value}.{name.rstrip('?')}", name.endswith("?")
            if free or isinstance(inner, str) and inner.endswith("?"):
                if not isinstance(inner, str):
                    tests.append(f"({part} IS NOT NULL AND {lacks(part, inner, depth)})")
            else:
                tests.append(lacks(part, inner, depth))
    return f"({' OR '.join(tests)})"


def _free_names(shape: Shape) -> bool:
    if isinstance(shape, dict):
        return any(map(_free_names, shape.values()))
    return isinstance(shape, tuple) or isinstance(shape, list) and _free_names(shape[0])


def fits_whole(value: str, typed: str, shape: Shape) -> str:
    """SQL: what ``fits`` says, from one pass over a VARIANT and its typed content instead of one
    for every level and value. Free names have no one schema; they are looked at one by one."""
    if _free_names(shape):
        return fits(value, shape)
    pattern = merged(shape).replace("\\", "\\\\")
    return f"(schema_of_variant({value}) RLIKE '^{pattern}$' AND NOT {lacks(typed, shape)})"


def infinite(value: str, shape: Shape, depth: int = 0) -> str | None:
    """SQL: whether a number of a value read by its shape is infinite (1e400 is JSON, but no
    double holds it). None where the shape has no such numbers."""
    item = f"n{depth}"
    if isinstance(shape, str):
        return f"abs({value}) = double('Infinity')" if shape.startswith("number") else None
    if isinstance(shape, dict):
        tests = [t for name, inner in shape.items()
                 if (t := infinite(f"{value}.{name.rstrip('?')}", inner, depth))]
        return f"({' OR '.join(tests)})" if tests else None
    rows = value if isinstance(shape, list) else f"map_values({value})"
    inner = infinite(item, shape[0] if isinstance(shape, list) else shape[1], depth + 1)
    return f"exists({rows}, {item} -> {inner})" if inner else None


def _not_utc(name: str) -> str:
    return (f"(try_to_timestamp({name}) IS NULL OR NOT {_utc_form(name)})")


def _utc_form(name: str) -> str:
    return (f"({name} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"
            "([.][0-9]+)?(Z|[+]00:00)$')")


def _unsafe(name: str) -> str:
    """An identifier that names a file may hold letters, digits, _ and - only."""
    return f"NOT ({name} RLIKE '^[A-Za-z0-9_-]+$')"


def _outside(name: str, least: int, most: int) -> str:
    return f"length({name}) NOT BETWEEN {least} AND {most}"


def _among(values: tuple[str, ...]) -> str:
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


def _twice(rows: str, name: str) -> str:
    return f"size(array_distinct(transform({rows}, r -> r.{name}))) < size({rows})"


def _any(rows: str, test: str) -> str:
    """Whether a test of row r, its place i or the row before holds anywhere."""
    return f"exists(transform({rows}, (r, i) -> {test}), x -> x)"


_HEAD = {"schema_version": "int", "run_id": "int"}
_WORD = {"word": "string", "start": "number", "end": "number", "probability?": "number"}
TRANSCRIPT = Kind(
    rules.TRANSCRIPT_SCHEMA_VERSION,
    {**_HEAD, "language": "string", "language_probability?": "number",
     "duration_seconds": "number", "declared_duration_seconds?": "number", "model": "string",
     "created_at": "string",
     "segments": [{"index": "int", "start": "number", "end": "number", "text": "string",
                   "words": [_WORD]}]},
    (("duration_not_positive", "duration_seconds <= 0"),
     ("probability_out_of_range", "language_probability NOT BETWEEN 0 AND 1 OR " + _any(
         "segments", "exists(r.words, w -> coalesce(w.probability NOT BETWEEN 0 AND 1, false))")),
     ("timestamp_not_utc", _not_utc("created_at")),
     ("indices_not_contiguous", _any("segments", "r.index <> i")),
     ("segment_not_ordered", _any("segments", "r.start < 0 OR r.end < r.start")),
     ("segments_not_sorted", _any("segments", "i > 0 AND r.start < get(segments, i - 1).start")),
     ("word_not_ordered", _any("segments", "exists(r.words, w -> w.end < w.start)")),
     ("word_outside_segment", _any(
         "segments", "exists(r.words, w -> w.start < r.start - 1e-6 OR w.end > r.end + 1e-6)")),
     ("words_not_sorted", _any(
         "segments", "exists(transform(r.words, (w, k) -> k > 0 AND w.start < "
                     "get(r.words, k - 1).start), x -> x)")),
     ("beyond_duration", _any("segments", "r.end > duration_seconds"))),
)
BATCHES = Kind(
    1,
    {**_HEAD, "model": "string",
     "batches": [{
         "chunk_id": "string", "raw_response": "string", "error?": "string", "model?": "string",
         "candidates": [{
             "start": "number", "end": "number", "category": "string", "topic": "string",
             "hook": "string", "summary": "string", "reason": "string",
             "scores": {name: "int" for name in rules.SCORE_NAMES}, "warnings": ["string"]}]}]},
    (("name_missing", "model = '' OR " + _any("batches", "r.chunk_id = ''")),
     ("chunk_answered_twice", _twice("batches", "chunk_id")),
     ("other_model", _any("batches", "r.model IS NOT NULL AND r.model <> model")),
     ("rating_out_of_range", _any("batches", "exists(r.candidates, c -> " + " OR ".join(
         f"c.scores.{name} NOT BETWEEN 0 AND 100" for name in rules.SCORE_NAMES) + ")")),
     ("unknown_category", _any(
         "batches", f"exists(r.candidates, c -> c.category NOT IN {_among(rules.CATEGORIES)})")),
     ("text_out_of_bounds", _any("batches", "exists(r.candidates, c -> " + " OR ".join(
         _outside(f"c.{name}", 1, most) for name, most in rules.TEXT_LIMITS.items()) + ")")),
     ("too_many_warnings", _any(
         "batches", f"exists(r.candidates, c -> size(c.warnings) > {rules.MAX_WARNINGS})")),
     ("failed_and_answered", _any("batches", "r.error IS NOT NULL AND size(r.candidates) > 0"))),
)
CANDIDATES = Kind(
    1,
    {**_HEAD, "proposed": "int",
     "candidates": [{"id": "string", "rank": "int", "start": "number", "end": "number",
                     "total_score": "number", "status": "string"}]},
    (("proposed_too_few", "proposed < size(candidates)"),
     ("unsafe_identifier", _any("candidates", _unsafe("r.id"))),
     ("ranks_not_contiguous", _any("candidates", "r.rank <> i + 1")),
     ("listed_twice", _twice("candidates", "id")),
     ("not_ordered", _any("candidates", "r.start < 0 OR r.end <= r.start")),
     ("score_out_of_range", _any("candidates", "r.total_score < 0 OR r.total_score > 100")),
     ("unknown_status", _any("candidates", "r.status <> 'suggested'"))),
)
CHUNKS = Kind(
    1,
    {**_HEAD, "chunks": [{"id": "string", "index": "int", "window_start": "number",
                          "window_end": "number", "start": "number", "end": "number"}]},
    (("unsafe_identifier", _any("chunks", _unsafe("r.id"))),
     ("indices_not_contiguous", _any("chunks", "r.index <> i")),
     ("listed_twice", _twice("chunks", "id")),
     ("not_ordered", _any("chunks", "r.end < r.start OR r.window_end <= r.window_start"))),
)
_KEPT = "abs(r.final_start - r.original_start) <= 1e-6 AND abs(r.final_end - r.original_end) <= 1e-6"
DECISIONS = Kind(
    1,
    {**_HEAD, "source_duration_seconds": "number", "created_at": "string", "updated_at": "string",
     "decisions": [{
         "candidate_id": "string", "decision": "string", "original_start": "number",
         "original_end": "number", "final_start?": "number", "final_end?": "number",
         "reason?": "string", "detail?": "string", "reviewed_at": "string"}]},
    (("timestamp_not_utc", f"{_not_utc('created_at')} OR {_not_utc('updated_at')} OR "
      + _any("decisions", _not_utc("r.reviewed_at"))),
     ("updated_before_created", "to_timestamp(updated_at) < to_timestamp(created_at)"),
     ("unknown_decision", _any(
         "decisions", "r.decision NOT IN ('approved', 'edited', 'rejected')")),
     ("original_not_ordered", _any(
         "decisions", "r.original_start < 0 OR r.original_end <= r.original_start")),
     ("interval_missing", _any(
         "decisions", "r.decision <> 'rejected' AND (r.final_start IS NULL OR r.final_end IS NULL)")),
     ("approved_moved", _any("decisions", f"r.decision = 'approved' AND NOT ({_KEPT})")),
     ("edited_not_moved", _any("decisions", f"r.decision = 'edited' AND {_KEPT}")),
     ("edited_not_ordered", _any(
         "decisions", "r.decision = 'edited' AND (r.final_start < 0 OR r.final_end <= r.final_start)")),
     ("rejected_with_interval", _any(
         "decisions",
         "r.decision = 'rejected' AND (r.final_start IS NOT NULL OR r.final_end IS NOT NULL)")),
     ("unknown_reason", _any("decisions", f"r.reason NOT IN {_among(rules.EDITORIAL_REASONS)}")),
     ("reason_without_rejection", _any(
         "decisions",
         "r.decision <> 'rejected' AND (r.reason IS NOT NULL OR r.detail IS NOT NULL)")),
     ("detail_without_reason", _any("decisions", "r.detail IS NOT NULL AND r.reason IS NULL")),
     ("other_needs_detail", _any(
         "decisions", "r.reason = 'other' AND trim(coalesce(r.detail, '')) = ''")),
     ("detail_too_long", _any("decisions", f"length(r.detail) > {rules.DETAIL_MAX_LENGTH}")),
     ("decided_twice", _twice("decisions", "candidate_id")),
     ("original_beyond_source", _any(
         "decisions", "r.original_end > source_duration_seconds + 1e-6")),
     ("beyond_source", _any("decisions", "r.final_end > source_duration_seconds + 1e-6"))),
)
_FILE = {"candidate_id": "string", "rank": "int", "start": "number", "end": "number",
         "filename": "string", "sha256": "string"}


def _file_rules(rows: str) -> tuple[tuple[str, str], ...]:
    return (
        ("dimensions_not_positive", "width <= 0 OR height <= 0"),
        ("unsafe_identifier", _any(rows, _unsafe("r.candidate_id"))),
        ("unsafe_filename", _any(rows, "NOT (r.filename RLIKE '^[A-Za-z0-9_-]+[.][A-Za-z0-9]+$')")),
        ("bad_digest", _any(rows, "NOT (r.sha256 RLIKE '^[0-9a-f]{64}$')")),
    )


#: Clip ranks keep the gaps that rejections leave; preview ranks have none.
CLIP_INDEX = Kind(
    2, {**_HEAD, "width": "int", "height": "int", "clips": [_FILE]},
    (*_file_rules("clips"),
     ("not_ordered", _any("clips", "r.start < 0 OR r.end <= r.start")),
     ("listed_twice", _twice("clips", "candidate_id")),
     ("ranks_not_increasing", _any(
         "clips", "r.rank < 1 OR i > 0 AND r.rank <= get(clips, i - 1).rank"))),
)
PREVIEW_INDEX = Kind(
    1, {**_HEAD, "width": "int", "height": "int", "previews": [_FILE]},
    (*_file_rules("previews"),
     ("not_ordered", _any("previews", "r.start < 0 OR r.end <= r.start")),
     ("listed_twice", _twice("previews", "candidate_id")),
     ("ranks_not_contiguous", _any("previews", "r.rank <> i + 1"))),
)
MANIFEST = Kind(
    rules.MANIFEST_SCHEMA_VERSION,
    {**_HEAD, "created_at": "string", "status": "string", "config_sha256": "string",
     "stages": ("map", {"fingerprint": "string", "stage_config_sha256": "string",
                        "schema_version": "int", "completed_at": "string"})},
    (("unknown_status", f"status NOT IN {_among(rules.RUN_STATUSES)}"),
     ("unknown_stage", f"exists(map_keys(stages), k -> k NOT IN {_among(rules.STAGES)})"),
     ("timestamp_not_utc", f"{_not_utc('created_at')} OR exists(map_values(stages), "
      f"r -> {_not_utc('r.completed_at')})")),
)
STAGE_CONFIG = Kind(
    1, {**_HEAD, "stage": "string", "settings": ("map", "string?")},
    (("unknown_stage", f"stage NOT IN {_among(rules.STAGES)}"),),
)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: its path and whole text."""
    return spark.read.option("wholetext", True).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def parse(docs: DataFrame, kind: Kind, text: str = "document") -> DataFrame:
    """Add ``doc`` (the typed content) and ``problem`` (NULL when accepted).

    Tests are in this order: the text is one JSON object, its version, its field names, names and
    kinds at every level (``wrong_shape``), numbers beyond a double (``not_finite``), then the rules
    of the kind. A rule about an optional
    field that is absent does not apply; no other value can be missing by then.
    """
    body = F.col(text)
    names = F.array(*[F.lit(n) for n in kind.names])
    needed = F.array(*[F.lit(n) for n in kind.required])
    # What is read from a text goes through a one-row explode: filters on ``problem`` or ``doc``
    # then use it instead of reading the text again for every value, some for each of its rows.
    read = F.struct(
        F.try_parse_json(body).alias("_json"), object_keys(body).alias("_keys"),
        F.from_json(body, ddl(kind.shape)).alias("doc"))
    held = docs.withColumn("_read", F.explode(F.array(read))).select("*", "_read.*").drop("_read")
    shaped = held.withColumns({
        "_fits": F.expr(fits_whole("_json", "doc", kind.shape)),
        "_version": F.try_variant_get("_json", "$.schema_version", "string"),
    })
    inner = shaped.select("*", *[
        F.expr(_inside(test, kind)).alias(f"_rule_{name}") for name, test in kind.rules])
    problem: list[tuple[str, Column]] = [
        ("not_json", F.col("_json").isNull()),
        ("schema_version", ~F.col("_version").eqNullSafe(F.lit(str(kind.version)))),
        ("missing_field", F.size(F.array_except(needed, "_keys")) > 0),
        ("unknown_field", F.size(F.array_except("_keys", names)) > 0),
        ("wrong_shape", ~F.coalesce("_fits", F.lit(False))),
        ("not_finite", F.coalesce(F.expr(infinite("doc", kind.shape) or "false"), F.lit(False))),
        *[(name, F.coalesce(F.col(f"_rule_{name}"), F.lit(False))) for name, _ in kind.rules],
    ]
    return inner.withColumn(
        "problem", F.coalesce(shape_problem(body), first_problem(problem))
    ).drop("_json", "_fits", "_version", "_keys", *[f"_rule_{n}" for n, _ in kind.rules])


def _inside(test: str, kind: Kind) -> str:
    """Rule texts name top-level fields; they live under ``doc``."""
    out = test
    for name in kind.names:
        out = re.sub(rf"(?<![.\w'`]){name}(?![\w'])", f"doc.{name}", out)
    return out


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("problem IS NULL").select("doc.*")


def transcript_segments(parsed: DataFrame) -> DataFrame:
    return accepted(parsed).select("run_id", F.explode("segments").alias("s")).select(
        "run_id", "s.index", "s.start", "s.end", "s.text")


def transcript_words(parsed: DataFrame) -> DataFrame:
    return (
        accepted(parsed).select("run_id", F.explode("segments").alias("s"))
        .select("run_id", F.col("s.index").alias("seg_index"),
                F.posexplode("s.words").alias("word_pos", "w"))
        .select("run_id", "seg_index", F.col("word_pos").cast("bigint").alias("word_pos"), "w.*")
    )


def batch_candidates(parsed: DataFrame) -> DataFrame:
    """One row per proposal; an answer without proposals keeps one row with NULL ordinal."""
    return (
        accepted(parsed).select("run_id", "model", F.explode("batches").alias("b"))
        .select("run_id", "b.chunk_id", "b.error",
                F.posexplode_outer("b.candidates").alias("ordinal", "c"))
        .select("run_id", "chunk_id", "error", F.col("ordinal").cast("bigint").alias("ordinal"),
                "c.*")
    )


def rows_of(parsed: DataFrame, array: str) -> DataFrame:
    """Explode one array of the accepted documents next to the run."""
    return accepted(parsed).select("run_id", F.explode(array).alias("r")).select("run_id", "r.*")


def stage_records(parsed: DataFrame) -> DataFrame:
    return accepted(parsed).select("run_id", F.explode("stages").alias("stage", "r")).select(
        "run_id", "stage", "r.*")


#: Files up to this size are one value in their task; larger ones pass through it piece by piece.
ONE_VALUE = 1 << 28


def _digests_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by file and place: one digest per file, whatever its size. A file that does not
    end in a line feed is told by its size."""
    path, size, read, sha = None, 0, 0, hashlib.sha256()

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"path": [path], "size_bytes": [size], "sha256": [sha.hexdigest()]})

    for batch in batches:
        for name, whole, line in zip(*[batch.column(c) for c in ("path", "size_bytes", "line")],
                                     strict=True):
            if name.as_py() != path:
                if path is not None:
                    yield ended()
                path, size, read, sha = name.as_py(), whole.as_py(), 0, hashlib.sha256()
            data = line.as_py()
            read += len(data) + 1
            sha.update(data)
            if read <= size:
                sha.update(b"\n")
    if path is not None:
        yield ended()


def file_digests(spark: SparkSession, paths: str | list[str], one_value: int = ONE_VALUE) -> DataFrame:
    """Name, size and SHA-256 of files; only digests leave the tasks. Empty files have no row:
    Spark's readers pass them over.

    The content of a file above ``one_value`` bytes is read as lines of bytes, by splits, sorted
    by place and passed through one digest: a digest takes bytes in order, so a file is one task's
    stream, but never one value (a single line is)."""
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(F.col("length") <= one_value).select(
        name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    if files.where(F.col("length") > one_value).select("path").isEmpty():
        return small
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))
    large = (
        lines.where(F.col("size_bytes") > one_value).repartition("path")
        .sortWithinPartitions("path", "split", "place").select("path", "size_bytes", "line")
        .mapInArrow(_digests_of_lines, "path string, size_bytes long, sha256 string")
    )
    return small.unionByName(large.select(name, "size_bytes", "sha256"))
