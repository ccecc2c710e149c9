import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cardlake.llm import resample
from cardlake.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows(text, longest):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=10, min_words=20, longest=1, size=10_000):
    def hist(texts):
        return Counter(zlib.crc32(x.encode()) % size for t in texts for x in windows(t, longest))

    s, t = hist(x for _, x in rows), hist(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + size) / ((s[b] + 1) * (T + size)))) for b in range(size)]
    out = []
    for i, text in rows:
        own = windows(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[zlib.crc32(x.encode()) % size] for x in own)
        out.append([i, len(own), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_matches_brute_force(spark):
    from cardlake.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = queries.QUERIES["op13_resample"](spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, [r.text for r in table(spark, sf, "benchmark").collect()])


TEXTS = [None, "", "...", "A b Ç ÉA é\xa0x\x85y 日本 12 a1", "x\x00y\x7fz", "word " * 50_000, "w" * 200_000, "Same text here and there " * 6, "\U0001f600 ok"]


@pytest.mark.parametrize("longest, min_words, percent", [(1, 20, 10), (1, 0, 100), (3, 2, 50), (2, 1, 33)])
def test_odd_rows_match_brute_force(spark, monkeypatch, longest, min_words, percent):
    monkeypatch.setattr(resample, "HELD", 64)
    r = random.Random(longest)
    rows = [(r.choice([None, 1, 2, *range(3, 60)]), r.choice(TEXTS) if r.random() < 0.4 else " ".join(r.choices(["a", "B", "c9", "ü", "-"], k=r.randint(0, 40))))
            for _ in range(150)] + [(4, TEXTS[7])] * 60
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, rank int, weight int").repartition(5)
    target = ["a b", None, "ü ü c9 same TEXT", ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, items, longest=longest, min_words=min_words, percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, percent, min_words, longest)


def test_pieces_give_the_windows_of_the_whole(monkeypatch):
    r = random.Random(1)
    for _ in range(50):
        text = "".join(r.choice("ab C\n-é") for _ in range(r.randint(0, 120)))
        for size in (1, 7, 1 << 16):
            monkeypatch.setattr(resample.pieces, "__defaults__", (size,))
            n, found = resample.window_buckets(text, resample.Buckets(97), 3)
            assert n == len(words(text))
            assert Counter(found.tolist()) == Counter(zlib.crc32(x.encode()) % 97 for x in windows(text, 3))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id long, text string")
    none = docs.where("false")
    assert resample.resample(none, docs).count() == 0
    assert sorted(map(tuple, resample.resample(docs, none.select("text"), percent=100).collect()), key=str) == brute([(1, "a " * 30), (2, "b")], [], percent=100)


def test_gains_in_doubles():
    g = resample.gains(np.array([0, 5, 7]), np.array([3, 0, 7]))
    assert g.tolist() == [math.floor(1000 * math.log((t + 1) * 15 / ((s + 1) * 13))) for s, t in ((0, 3), (5, 0), (7, 7))]
