"""A minimal acyclic transducer from words to numbers, kept in one file that tasks map.

States that accept the same endings are one state, so words share suffixes as well as prefixes.
Every arc has an output, the number of words that sort before all words through it; the outputs on
a word's path add up to the word's place in sorted order, and that place leads to its ids. Arcs lie
in one table sorted by (state, byte), so many words walk at once, one binary search a letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

#: The arrays of the file in their order, and what their sizes are called in its head.
_HEAD = ("arcs", "states", "words", "ids", "root", "longest")
_PARTS = (("keys", "<i8", "arcs", 0), ("ends", "<i8", "words", 1), ("targets", "<i4", "arcs", 0),
          ("outputs", "<i4", "arcs", 0), ("id_table", "<u4", "ids", 0), ("final", "u1", "states", 0))


class _Builder:
    """Takes words in sorted order. The nodes on the last word's path are open, all others are
    settled: equal ones are one state."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.sizes: list[int] = []
        self.open: list[list] = [[False, []]]  # accepting, settled arcs (byte, state)
        self.last = b""

    def _settle(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            state = self._state(self.open.pop())
            self.open[-1][1].append((self.last[len(self.open) - 1], state))

    def _state(self, node: list) -> int:
        key = (node[0], *node[1])
        found = self.known.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
            self.sizes.append(node[0] + sum(self.sizes[to] for _, to in node[1]))
        return found

    def add(self, word: bytes) -> None:
        shared = 0
        for a, b in zip(self.last, word):
            if a != b:
                break
            shared += 1
        self._settle(shared)
        self.open += [[False, []] for _ in word[shared:]]
        self.open[-1][0] = True
        self.last = word

    def finish(self) -> int:
        self._settle(0)
        return self._state(self.open.pop())


def compile_lexicon(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The file of distinct words, given in sorted order, with their ids (little-endian 32-bit
    numbers). Entries pass by one at a time. No words give an automaton without words."""
    builder = _Builder()
    table, ends, longest = bytearray(), [0], 0
    for word, ids in entries:
        builder.add(word)
        table += ids
        ends.append(len(table) // 4)
        longest = max(longest, len(word))
    root = builder.finish()
    keys, targets, outputs = [], [], []
    for state, (accepts, *arcs) in enumerate(builder.states):
        before = int(accepts)
        for byte, to in arcs:
            keys.append(state << 8 | byte)
            targets.append(to)
            outputs.append(before)
            before += builder.sizes[to]
    parts = {
        "keys": keys, "targets": targets, "outputs": outputs, "ends": ends,
        "id_table": np.frombuffer(table, "<u4"), "final": [state[0] for state in builder.states],
    }
    head = {"arcs": len(keys), "states": len(builder.states), "words": len(ends) - 1,
            "ids": ends[-1], "root": root, "longest": longest}
    return np.array([head[name] for name in _HEAD], "<i8").tobytes() + b"".join(
        np.asarray(parts[name], kind).tobytes() for name, kind, _, _ in _PARTS)


class Lexicon:
    """The mapped file. Pages are read as words need them and shared by a machine's tasks."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        self.head = dict(zip(_HEAD, data[:8 * len(_HEAD)].view("<i8").tolist(), strict=True))
        at = 8 * len(_HEAD)
        for name, kind, count, more in _PARTS:
            size = (self.head[count] + more) * np.dtype(kind).itemsize
            setattr(self, name, data[at:at + size].view(kind))
            at += size

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of every word, -1 for words that are not in the lexicon."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.head["root"], np.int64)
        found = np.zeros(len(words), np.int64)
        state[lengths > self.head["longest"]] = -1
        for step in range(self.head["longest"]):
            on = np.flatnonzero((lengths > step) & (state >= 0))
            if not len(on):
                break
            key = state[on] << 8 | letters[starts[on] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state[on] = np.where(self.keys[arc] == key, self.targets[arc], -1)
            found[on] += self.outputs[arc]
        found[state < 0] = -1
        at = np.flatnonzero(state >= 0)
        found[at[self.final[state[at]] == 0]] = -1
        return found

    def ids(self, number: int) -> np.ndarray:
        return self.id_table[self.ends[number]:self.ends[number + 1]]
