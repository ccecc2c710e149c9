"""A byte-level BPE vocabulary read from a tokenizers JSON file: token bytes, merge ranks,
special strings and the proven places where a text may be cut without changing its tokens.

The split pattern has no look-behind and none of its alternatives crosses from a
non-space character into a following space: letters, digits and other signs take at most
one space, in front.  So a token boundary lies before every space or line feed that follows
a non-space character, whatever surrounds it, and the tokens on both sides are those of the
two parts alone.  Special strings hold no white space, so such a cut never falls inside one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: fixed value: the public split pattern of byte-level vocabularies
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
STABLE = re.compile(r"(?<=\S)[ \n]")


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class ByteBpe:
    tokens: list[bytes]
    byte_ids: list[int]
    #: (left id, right id) -> rank, and the merged id of each rank
    ranks: dict[tuple[int, int], int]
    merged: list[int]
    special: dict[str, int]
    #: the pairs as sorted keys (left id << 32 | right id) and their ranks; for many words at once
    pair_keys: np.ndarray
    pair_ranks: np.ndarray

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, one past the last rank where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.merged))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as ``merge`` gives them, in little-endian unsigned 32-bit
        integers.  All words are merged in lock-step: each round merges, in every word that
        still has a pair, its leftmost pair of the lowest rank."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= 64]
        for i, w in enumerate(words):
            if len(w) > 64:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
        if not short or not self.merged:
            for i in short:
                out[i] = np.array([self.byte_ids[b] for b in words[i]], "<u4").tobytes()
            return out
        none = len(self.merged)
        merged = np.array(self.merged, np.int64)
        place = np.array(short)
        size = np.array([len(words[i]) for i in short])
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        start = np.cumsum(size) - size
        rank = np.append(self._ranks(ids[:-1], ids[1:]), none)
        rank[start[1:] - 1] = none
        while len(place):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            live = best >> 32 < none
            if not live.all():
                whole = np.repeat(~live, size)
                flat, ends = ids[whole].astype("<u4").tobytes(), np.cumsum(size[~live]) * 4
                for i, a, b in zip(place[~live].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[i] = flat[a:b]
                moved = np.cumsum(whole)
                at = (best[live] & 0xFFFFFFFF)
                at -= moved[at]
                best = best[live] >> 32
                ids, rank, place, size = ids[~whole], rank[~whole], place[live], size[live]
                start = np.cumsum(size) - size
                if not len(place):
                    break
            else:
                at, best = best & 0xFFFFFFFF, best >> 32
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = merged[best]
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            start = np.cumsum(size) - size
            at -= np.arange(len(at))
            rank[at] = none
            right = at + 1 < start + size
            rank[at[right]] = self._ranks(ids[at[right]], ids[at[right] + 1])
            left = at > start
            rank[at[left] - 1] = self._ranks(ids[at[left] - 1], ids[at[left]])
        return out

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: adjacent pairs merged in rank order, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        find, none, merged = self.ranks.get, len(self.merged), self.merged
        ranks = [find(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [merged[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = find((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = find((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs, for words of any length."""
        n = len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        find = self.ranks.get
        # entries are (rank, position, left id, right id); stale ones are skipped
        queue = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1]))) is not None]
        heapify(queue)
        while queue:
            rank, i, a, b = heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (m := find((ids[i], ids[k]))) is not None:
                    heappush(queue, (m, i, ids[i], ids[k]))
            if (h := left[i]) >= 0 and (m := find((ids[h], ids[i]))) is not None:
                heappush(queue, (m, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """The vocabulary in ``path``; raises ValueError for other kinds of tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = not spec["normalizer"] and not any(model.get(k) for k in (
        "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout"))
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(re.search(r"\s", s) for s in special):
        raise ValueError(f"{path} has special strings with white space")
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for s, i in vocab.items():
        tokens[i] = s.encode() if s in special else bytes(map(alphabet.__getitem__, s))
    for s, i in special.items():
        tokens[i] = s.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(pairs)}
    merged = [vocab[a + b] for a, b in pairs]
    order = sorted(ranks)
    keys = np.array([a << 32 | b for a, b in order], np.int64)
    return ByteBpe(tokens, [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], ranks, merged, special,
                   keys, np.array([ranks[p] for p in order], np.int64))


def split_words(text: str) -> list[str]:
    """The words of the split pattern.  Letters with at most one space in front are one word,
    and so is a run of closing signs behind them."""
    core = text.rstrip(",.;:!?")
    if core.isalpha() or (core[:1] == " " and core[1:].isalpha()):
        return [core] if len(core) == len(text) else [core, text[len(core):]]
    return PATTERN.findall(text)


def split_special(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """(text, None) parts and (string, id) specials, in order."""
    if not special or not any(s in text for s in special):
        yield text, None
        return
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text):
        if part:
            yield part, special.get(part)


def stable_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only at proven boundaries."""
    start = 0
    while len(text) - start > size:
        m = STABLE.search(text, start + size)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text
