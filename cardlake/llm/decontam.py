"""Benchmark decontamination by SimHash windows.

A benchmark item is a sequence of word shingles, and a text leaks it if one of its windows
of as many shingles has a weighted Jaccard similarity (shingles weighted by how often they
occur) of at least ``similarity``.  Each window gets a SimHash fingerprint from running bit
counts.  Items of one size are indexed by eight blocks of their fingerprints; an item lies
within ``RADIUS`` bits of a window only if some block differs by at most that block's
radius, so the balls around the blocks find every item within the radius.  Complete
distance and exact similarity then decide.

Fingerprints tell the similarity only of shingles that occur once: a repeated shingle that
differs in number moves many bits at a time.  So an item that repeats a shingle, and every
item around a repeated shingle of a text, is compared by counts of shared shingles instead,
whatever the distance.

A window that shares no shingle with any item has similarity zero and is never hashed:
only windows around shared shingles are, which is a small part of a corpus.

The index of up to ``PACK`` items, of about ``PACK_BYTES`` at most, is broadcast; more items take further passes over the
texts, so what a task holds does not grow with the benchmark.  Texts are scanned in place:
no shuffle, no group.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType

from cardlake.llm.schemas import extended
from cardlake.llm.simhash import segment_radii

SHINGLE = 5
SIMILARITY = 0.8
#: largest Hamming distance of a candidate.  Windows of similarity 0.8 whose shingles, and
#: the item's, occur once differ by 10 of 64 bits on average, with a standard deviation of 3
RADIUS = 20
BLOCKS = 8
#: items of one pass, and about how many bytes of them
PACK = 20_000
PACK_BYTES = 1 << 24
#: windows fingerprinted at once
SPAN = 65_536
#: characters hashed at once
SLICE = 1 << 18
#: fixed at random, odd
BASE = 0x9E6C63D0876A9A35

_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return [w for u in text.split() for w in _WORD.findall(u.lower())]


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """A random number for every code point, zero for those that are no word characters."""
    word = np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(0x110000)), bool, 0x110000)
    return np.where(word, np.random.default_rng(5).integers(1, 1 << 64, 0x110000, np.uint64), np.uint64(0))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number modulo 2 ** 64, and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _hashed(text: str) -> np.ndarray:
    code = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    n = len(code)
    up, down = _powers(max(SLICE, 1 << n.bit_length()))
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = code != 0
    edges = np.flatnonzero(inner[1:] != inner[:-1])  # a word's first place, its end, the next one's, ...
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(code * up[:n], out=sums[1:])
    first, end = edges[::2], edges[1::2]
    h = (sums[end] - sums[first]) * down[first]
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each of ``words_of(text)``, made for all characters of a slice at once: the
    sum of the characters' numbers, each times a power of its place in the word."""
    if len(text) <= SLICE:
        return _hashed(text)
    parts, start = [], 0
    while start < len(text):
        m = _SPACE.search(text, start + SLICE)
        end = m.start() if m else len(text)
        parts.append(_hashed(text[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def window_fingerprints(h: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each run of ``n`` shingle hashes: a bit is set if it is in over half."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=ones[1:])
    return np.packbits(2 * (ones[n:] - ones[:-n]) > n, axis=1, bitorder="little").view(np.uint64).ravel()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@dataclass
class SizeIndex:
    """Items of one shingle length and number of shingles, and their block tables."""

    items: list[int] = field(default_factory=list)
    prints: np.ndarray = None
    #: whether some item repeats a shingle
    repeats: bool = False
    tables: list[tuple[int, list[np.ndarray]]] = field(default_factory=list)

    def build(self) -> None:
        width = 64 // BLOCKS
        for b, r in enumerate(segment_radii(RADIUS, BLOCKS)):
            shift, buckets = b * width, defaultdict(list)
            own = (self.prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).tolist()
            ball = [sum(1 << p for p in c) for d in range(r + 1) for c in combinations(range(width), d)]
            for i, v in enumerate(own):
                for x in ball:
                    buckets[v ^ x].append(i)
            self.tables.append((shift, [np.array(buckets.get(v, ()), np.int32) for v in range(1 << width)]))

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(distance, window, item) of all pairs within the radius, nearest first."""
        width = 64 // BLOCKS
        found = []
        for shift, buckets in self.tables:
            v = (prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
            for value in np.unique(v):
                if len(own := buckets[value]):
                    at = np.flatnonzero(v == value)
                    found.append(np.repeat(at, len(own)) * len(self.items) + np.tile(own, len(at)))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        window, item = pairs // len(self.items), pairs % len(self.items)
        far = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
        order = np.lexsort((window, far))
        order = order[far[order] <= RADIUS]
        yield from zip(far[order].tolist(), window[order].tolist(), item[order].tolist(), strict=True)


class ItemIndex:
    """Index of up to ``PACK`` benchmark items."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, similarity: float = SIMILARITY):
        self.similarity = similarity
        self.ids: list[int] = []
        self.shingles: list[Counter] = []
        #: distinct shingle hashes of each item and how often they occur
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        #: (number of shingles, place among the items of that number) of each item
        self.place: list[tuple[int, int]] = []
        self.sizes: dict[tuple[int, int], SizeIndex] = {}
        owners: dict[int, dict[int, set[int]]] = {}
        holders = defaultdict(list)
        prints = defaultdict(list)
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            k = min(shingle, len(words))
            n = len(words) - k + 1
            h = shingle_hashes(word_hashes(text), k)
            for x in h.tolist():
                owners.setdefault(k, {}).setdefault(x, set()).add(n)
            size = self.sizes.setdefault((k, n), SizeIndex())
            distinct, counts = np.unique(h, return_counts=True)
            holders[k].append((distinct, np.full(len(distinct), len(self.ids), np.int32)))
            size.repeats |= len(distinct) < n
            self.counts.append((distinct, counts))
            self.place.append((n, len(size.items)))
            size.items.append(len(self.ids))
            prints[k, n].append(window_fingerprints(h, n)[0])
            self.ids.append(item_id)
            self.shingles.append(Counter(tuple(words[i:i + k]) for i in range(n)))
        for key, size in self.sizes.items():
            size.prints = np.array(prints[key], np.uint64)
            size.build()
        #: by shingle length: sorted shingles, a filter of their low bits, the item sizes of each
        self.known = {}
        for k, own in owners.items():
            keys = np.array(sorted(own), np.uint64)
            low = np.zeros(1 << 22, bool)
            low[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.known[k] = keys, low, [tuple(sorted(own[x])) for x in keys.tolist()]
        #: by shingle length: the items of each of the sorted shingles, as (first, items)
        self.holders = {}
        for k, parts in holders.items():
            keys, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            self.holders[k] = np.append(np.searchsorted(keys[order], self.known[k][0]), len(order)), own[order]

    def _windows(self, k: int, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By item size: spans [lo, hi) of window starts that reach a shared shingle."""
        keys, low, sizes = self.known[k]
        hit = np.flatnonzero(low[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
        good = keys[at] == h[hit]
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, i in zip(hit[good].tolist(), at[good].tolist(), strict=True):
            for n in sizes[i]:
                last = max(0, len(h) - n)
                lo, hi = min(max(0, p - n + 1), last), min(p, last) + 1
                own = spans[n]
                if own and lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        return spans

    def _counted(self, k: int, n: int, m: int, part: np.ndarray, again: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(place, windows) of the items of ``n`` shingles that windows of ``m`` of ``part``
        resemble enough, by counts of shared shingles: of all items, or without ``again``
        of those that repeat a shingle."""
        keys, (begin, holder) = self.known[k][0], self.holders[k]
        at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
        which, often = np.unique(at[keys[at] == part], return_counts=True)
        width = begin[which + 1] - begin[which]
        to = np.repeat(begin[which] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        items, to = np.unique(holder[to], return_inverse=True)
        # a window that is similar enough shares this many shingles, and the span no fewer
        need = self.similarity * (n + m) / (1 + self.similarity) - 1e-9
        for i in items[np.bincount(to, np.repeat(often, width), len(items)) >= need].tolist():
            hashes, counts = self.counts[i]
            if self.place[i][0] != n or not (again or len(hashes) < n):
                continue
            shared = np.zeros(len(part) - m + 1, np.int64)
            for x, c in zip(hashes, counts, strict=True):
                ones = np.append(0, np.cumsum(part == x))
                shared += np.minimum(c, ones[m:] - ones[:-m])
            if len(good := np.flatnonzero(shared >= need)):
                yield self.place[i][1], good

    def _near(self, k: int, n: int, m: int, part: np.ndarray) -> list[tuple[int, int, int]]:
        """(distance, window, place) of the items of ``n`` shingles that windows of ``m`` of
        ``part`` may leak, nearest first."""
        size, prints = self.sizes[k, n], window_fingerprints(part, m)
        again = len(np.unique(part)) < len(part)
        near = [] if again else list(size.candidates(prints))
        if not (again or size.repeats):
            return near
        for i, good in self._counted(k, n, m, part, again):
            near = [x for x in near if x[2] != i]
            near += zip(np.bitwise_count(prints[good] ^ size.prints[i]).tolist(), good.tolist(), [i] * len(good), strict=True)
        return sorted(near)

    def leaks(self, text: str, word_hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of each item that the text leaks, at its
        window of the least distance (then the first) that is similar enough."""
        out, words = [], None
        for k in self.known:
            h = shingle_hashes(word_hashes, k)
            if not len(h):
                continue
            for n, spans in sorted(self._windows(k, h).items()):
                size = self.sizes[k, n]
                m = min(n, len(h))  # a text shorter than the item is one window
                if m < self.similarity * n:
                    continue
                done: set[int] = set()
                for lo, hi in spans:
                    for a in range(lo, hi, SPAN):
                        b = min(hi, a + SPAN)
                        for _, w, i in self._near(k, n, m, h[a:b - 1 + m]):
                            item = size.items[i]
                            if item in done:
                                continue
                            words = words if words is not None else words_of(text)
                            start = a + w
                            s = weighted_jaccard(Counter(tuple(words[j:j + k]) for j in range(start, start + m)), self.shingles[item])
                            if s >= self.similarity:
                                done.add(item)
                                out.append((self.ids[item], s, start, m + k - 1))
        return out

    def scan(self, texts: Iterable[str]) -> Iterator[list[tuple[int, float, int, int]]]:
        """The leaks of each text."""
        return (self.leaks(t, word_hashes(t)) for t in texts)


def _packs(benchmark: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> Iterator[ItemIndex]:
    """Indexes of the distinct items, dealt to packs by their hash."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    packs = max(1, -(-n // PACK), -(-size // PACK_BYTES))
    for k in range(packs):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(packs)) == k) if packs > 1 else items
        yield ItemIndex(sorted(((r.id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x[0], x[1])), shingle, similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, item, similarity, first_word, n_words): one row per row of ``docs`` and item that
    its text leaks, with the place of the window found.

    Words are runs of word characters, lower-cased.  An item of fewer words than a shingle
    is one shingle of all its words; a text with fewer shingles than an item is one window.
    Null, empty and wordless texts and items leak nothing.  Null and repeated ids and rows
    give rows each, repeated items (same id and text) count once.  Other columns are
    ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = extended(rows.select("id").schema, ("item", benchmark.schema[item_col].dataType), ("similarity", DoubleType()),
                      ("first_word", LongType()), ("n_words", LongType()))
    names, kind = ["id", "item", "similarity", "first_word", "n_words"], to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for index in _packs(benchmark, item_col, item_text_col, shingle, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(shared.value.scan(t.as_py() or "" for t in b.column("text")))
                flat = [x for g in got for x in g]
                if flat:
                    at = pa.array(np.repeat(np.arange(len(got)), [len(g) for g in got]))
                    item, *rest = ([x[j] for x in flat] for j in range(4))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(item, kind), *map(pa.array, rest)], names=names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text leaks no item; as ``find_leaks``."""
    columns, schema = docs.columns, docs.schema
    at = columns.index(text_col)
    for index in _packs(benchmark, item_col, item_text_col, shingle, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaks = shared.value.scan(t.as_py() or "" for t in b.column(at))
                yield b.filter(pa.array([not x for x in leaks], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
