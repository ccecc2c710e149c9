"""Minimal acyclic transducer from words to token ids, in one file that is memory-mapped.

Sorted words are added one by one and every finished state is merged with an equal one, so
common suffixes are shared.  Each arc carries the number of words passed by before it; the
outputs along a path add up to the word's position, which selects its ids.  Words are
looked up in lock-step: one vectorised arc search per byte position for all words at once.
"""

from __future__ import annotations

import mmap
from array import array
from collections.abc import Iterable, Sequence

import numpy as np

MAGIC = 0x4C584931


def build(entries: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The file for (word, ids) entries with distinct, non-empty words, in any order; ids as
    little-endian unsigned 32-bit integers."""
    entries = sorted(entries)
    register: dict[tuple, int] = {}  # states by final mark and arcs, numbered as they come: targets first
    path: list[list] = [[False, []]]  # open states of the last word: final, arcs
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, arcs = path.pop()
            state = register.setdefault((final, tuple(arcs)), len(register))
            path[-1][1].append((last[len(path) - 1], state))

    for word, _ in entries:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        close(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    close(0)
    below: list[int] = []
    finals, keys, targets, outputs = array("I"), array("I"), array("I"), array("I")
    for s, (final, arcs) in enumerate([*register, (path[0][0], tuple(path[0][1]))]):
        finals.append(final)
        n = int(final)
        for label, target in arcs:
            keys.append(s << 8 | label)
            targets.append(target)
            outputs.append(n)
            n += below[target]
        below.append(n)
    starts = np.cumsum([0, *(len(x) // 4 for _, x in entries)])
    parts = [np.asarray(x, "<u4") for x in (keys, targets, outputs, finals, starts)]
    parts.append(np.frombuffer(b"".join(x for _, x in entries), "<u4"))
    header = np.asarray([MAGIC, *(len(p) for p in parts)], "<u4")
    return b"".join(p.tobytes() for p in (header, *parts))


class Lexicon:
    """Memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        data = np.frombuffer(self.map, "<u4")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is no lexicon file")
        cuts = np.cumsum([7, *map(int, data[1:7])])
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = (
            data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.ids_at = 4 * int(cuts[-2])

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """Position of each word among the sorted entries, -1 if it is not in the lexicon."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state = np.full(len(live), len(self.final) - 1, np.int64)
        number = np.zeros(len(live), np.int64)
        at = 0
        while len(live):
            key = state << 8 | text[start[live] + at]
            arc = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, number = live[ok], arc[ok], number[ok]
            state, number, at = self.targets[arc].astype(np.int64), number + self.outputs[arc], at + 1
            ended = size[live] == at
            done = ended & (self.final[state] == 1)
            found[live[done]] = number[done]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return found

    def ids_of(self, numbers: np.ndarray) -> list[bytes]:
        """The ids of each entry, as they are in the file; anything for -1."""
        ends = self.starts.astype(np.int64) * 4 + self.ids_at
        at = np.clip(numbers, 0, max(0, len(ends) - 2))
        return [self.map[a:b] for a, b in zip(ends[at].tolist(), ends[np.minimum(at + 1, len(ends) - 1)].tolist(), strict=True)]
