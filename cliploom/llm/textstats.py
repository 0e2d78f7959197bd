"""Counts over whole texts, taken in tasks by a vectorized function."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE, SYMBOL, CONTINUED, UPPER, DIGIT, MARK = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"!\"'(),-./:;?@[\\]^_`{}~+=")] = MARK
_KIND[list(b"\t\n\x0b\x0c\r ")] = SPACE
_KIND[list(b"#*$%&|<>")] = SYMBOL
_KIND[0x80:0xC0] = CONTINUED
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_marks", "n_upper", "n_digits")


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of `size` words that occur at least twice in the text."""
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    codes = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    windows = codes[:len(codes) - size + 1]
    for i in range(1, size):
        # numbers of distinct windows stay below the number of words: no overflow
        if i > 1:
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * len(ids) + codes[i:len(codes) - size + 1 + i]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    inside = np.zeros(len(codes), bool)
    for i in range(size):
        inside[i:len(codes) - size + 1 + i] |= again
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of one text; null counts as empty."""
    data = (text or "").encode()
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=7)
    words = data.split()  # bytes split at exactly the six ASCII white spaces
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), len(data) - int(kinds[SPACE] + kinds[CONTINUED]), int(kinds[SYMBOL]),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), int(kinds[MARK]),
            int(kinds[UPPER]), int(kinds[DIGIT]))


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FIELDS]))
def stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_stats(t) for t in texts], columns=list(FIELDS), dtype="int64")
