"""Token counts by field and section, from one encoding of the whole document.

The fields of a document are joined by line feeds and encoded once. A byte-level vocabulary spells
every text exactly, so the tokens' byte lengths give their spans, and an interval join of spans
and sections (two sorted lists, within the task that encoded the document) says where they lie.
A section is a line with its line feed; a field's separator belongs to the field before it.

A token that crosses a boundary is counted once, in the section that the rule names: `first` (of
its first byte), `last` (of its last byte) or `most` (of most of its bytes, the earlier on a tie).
The counts of a document's sections thus add up to the tokens of the whole document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import column

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
RULES = ("first", "last", "most")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def sections_of(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token and whether it crosses a boundary.

    tokens, sections: byte positions of n + 1 ends (starts, and the end of the text). A token
    whose bytes lie in several sections crosses."""
    if not len(sections) - 1 or not len(tokens) - 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    first = np.searchsorted(sections, tokens[:-1], "right") - 1
    last = np.searchsorted(sections, tokens[1:] - 1, "right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for at in np.flatnonzero(crossing):
        inside = np.arange(first[at], last[at] + 1)
        shared = (np.minimum(sections[inside + 1], tokens[at + 1])
                  - np.maximum(sections[inside], tokens[at]))
        chosen[at] = inside[np.argmax(shared)]
    return chosen, crossing


def cut_sections(fields: Sequence[str | None]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The joined text and (field, section, characters, bytes) of its sections in order. A null
    or empty field has one section without characters (but for its separator)."""
    texts = [text or "" for text in fields]
    rows = []
    for i, text in enumerate(texts):
        whole = text + "\n" * (i < len(texts) - 1)
        lines = text.split("\n")
        pieces = [line + "\n" for line in lines[:-1]] + [lines[-1]] * bool(lines[-1] or len(lines) == 1)
        if len(whole) > len(text):
            pieces[-1] += "\n"
        rows += [(i, k, len(piece), len(piece.encode())) for k, piece in enumerate(pieces)]
    return "\n".join(texts), rows


COUNTED = ("field string, section int, char_start long, char_end long, n_tokens long, "
           "n_crossing long")


def _counter(ranks: dict[bytes, int], names: Sequence[str], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            rows, fields, chars, counts, crossings = [], [], [], [], []
            for i, texts in enumerate(zip(*[batch.column(f"text_{n}").to_pylist()
                                            for n in range(len(names))], strict=True)):
                text, cut = cut_sections(texts)
                found = lengths[encoder.encode_to_numpy(text)]
                tokens = np.concatenate([[0], np.cumsum(found)])
                table = np.array(cut, np.int64).reshape(-1, 4)
                ends = np.concatenate([[0], np.cumsum(table[:, 3])])
                at, crossing = sections_of(tokens, ends, rule)
                rows.append(np.full(len(table), i))
                fields.append(table[:, :2])
                chars.append(np.concatenate([[0], np.cumsum(table[:, 2])]))
                counts.append(np.bincount(at, minlength=len(table)))
                crossings.append(np.bincount(at[crossing], minlength=len(table)))
            if not rows:
                continue
            which = np.concatenate(fields)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(pa.array(np.concatenate(rows))),
                pa.array(np.array(names, object)[which[:, 0]], pa.string()),
                pa.array(which[:, 1], pa.int32()),
                pa.array(np.concatenate([c[:-1] for c in chars])),
                pa.array(np.concatenate([c[1:] for c in chars])),
                pa.array(np.concatenate(counts)), pa.array(np.concatenate(crossings)),
            ], ["doc", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return run


def count_tokens(docs: DataFrame, fields: Sequence[str] = ("text",), key: str = "doc_id",
                 rule: str = "most", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per section of every document: key, field, section, char_start, char_end (in the
    joined fields), n_tokens, n_crossing (those of them that reach into another section).

    A row of docs never goes without a row: null and empty fields have one empty section. Rows
    with one key, nulls included, are counted each. Strings of control tokens in a text are
    ordinary text. An empty table gives an empty result. No shuffle: the vocabulary (fixed size)
    goes to the tasks with the function."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.select(column(key)).schema[0].dataType.simpleString()
    texts = docs.select(column(key).alias("doc"), *[column(f).cast("string").alias(f"text_{i}")
                                                  for i, f in enumerate(fields)])
    counted = texts.mapInArrow(
        _counter(read_ranks(vocabulary), list(fields), rule), f"doc {kind}, {COUNTED}")
    return counted.select(F.col("doc").alias(key), "field", "section", "char_start", "char_end",
                          "n_tokens", "n_crossing")
