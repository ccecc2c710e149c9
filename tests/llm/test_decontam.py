import random
from collections import Counter

import numpy as np
import pytest

from cardlake.llm import decontam, queries
from cardlake.session import table
from tests.conftest import SF_SMALL


def brute(docs, items, shingle=5, similarity=0.8):
    """(doc row, item id) of all leaks by comparing every window of the item's size exactly."""
    out = set()
    for r, text in enumerate(docs):
        words = decontam.words_of(text or "")
        for item_id, item in items:
            iw = decontam.words_of(item or "")
            if not iw:
                continue
            k = min(shingle, len(iw))
            want = Counter(tuple(iw[i:i + k]) for i in range(len(iw) - k + 1))
            n = len(iw) - k + 1
            have = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
            if not set(have) & set(want):
                continue
            for s in range(max(1, len(have) - n + 1)):
                w = Counter(have[s:s + n])
                if sum((w & want).values()) / sum((w | want).values()) >= similarity:
                    out.add((r, item_id))
                    break
    return out


def passages(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 50)))) for i in range(20)] + [(90, "two words"), (91, "Hapax!"), (92, ""), (93, None),
                                                                                        (94, "ab ab ab ab ab ab ab ab ab ab ab ab ab")]
    docs = [None, "", " . ", "hapax", "no hapaxes here", "x two, WORDS y", "ab " * 40, "ab " * 3000]
    for i, t in items[:20]:
        w = t.split()
        pad = [word() for _ in range(30)]
        docs.append(" ".join(pad + w + pad))
        docs.append(t.upper().replace(" ", ", "))
        docs.append(" ".join(w[: len(w) // 2]))
        for edits in (1, 2, 4):
            v = list(w)
            for _ in range(edits):
                j = r.randrange(len(v))
                kind = r.randrange(3)
                v[j:j + 1] = [] if kind == 0 else [word()] if kind == 1 else [v[j], word()]
            docs.append(" ".join(pad + v + pad))
        docs.append(" ".join(w[3:]))
        docs.append(" ".join(pad + w[: len(w) // 2] + pad[:2] + w[len(w) // 2:]))
    return docs, items


def test_leaks_match_brute_force(spark, monkeypatch):
    docs, items = passages()
    want = brute(docs, items)
    assert len(want) > 60
    df = spark.createDataFrame([(i, t, 1, 0.5) for i, t in enumerate(docs)], "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    for pack in (20_000, 7):
        monkeypatch.setattr(decontam, "PACK", pack)
        rows = decontam.find_leaks(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
        kept = sorted(r.doc_id for r in decontam.drop_leaks(df, bench).collect())
        assert kept == sorted(set(range(len(docs))) - {d for d, _ in want})
    for r in rows:
        words = decontam.words_of(docs[r.doc_id])
        assert r.first_word + r.n_words <= len(words) and 0.8 <= r.similarity <= 1
    assert decontam.drop_leaks(df, bench).columns == df.columns


def test_empty_tables_and_null_ids(spark):
    docs, items = passages()
    df = spark.createDataFrame([(None, docs[8]), (None, docs[8]), (1, docs[8])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [r.doc_id for r in decontam.find_leaks(df, bench).collect()].count(None) == 2
    assert decontam.find_leaks(df.where("false"), bench).count() == 0
    assert decontam.find_leaks(df, bench.where("false")).count() == 0
    assert decontam.drop_leaks(df, bench.where("false")).count() == 3
    assert decontam.drop_leaks(df, bench).count() == 0


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    size = decontam.SizeIndex(list(range(40)), rng.integers(0, 2**64, 40, np.uint64))
    size.build()
    prints = np.concatenate([rng.integers(0, 2**64, 50, np.uint64), size.prints[rng.integers(0, 40, 200)]])
    for i in range(50, 250):
        for b in rng.choice(64, i % 26, replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    far = np.bitwise_count(prints[:, None] ^ size.prints[None])
    want = {(int(far[w, i]), w, i) for w, i in zip(*np.nonzero(far <= decontam.RADIUS))}
    got = list(size.candidates(prints))
    assert set(got) == want and [x[0] for x in got] == sorted(x[0] for x in got)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_window_fingerprints(n):
    h = np.random.default_rng(n).integers(0, 2**64, 30, np.uint64)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[i:i + n]) > n) for i in range(31 - n)]
    assert decontam.window_fingerprints(h, n).tolist() == want


def test_query_matches_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents").collect()
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    want = {(docs[i].doc_id, j) for i, j in brute([d.text for d in docs], items)}
    df = queries.QUERIES["op7_decontam"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    assert {(r.doc_id, r.item_id) for r in df.collect()} == want and want


def repeated(seed=3):
    """Items and windows at the limit where the difference lies in a repeated shingle."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 7)))
    items, docs = [], []
    for i in range(30):
        a, b, pad = ([word() for _ in range(r.randint(20, 40))] for _ in range(3))
        # a run of one word is shorter in the text than in the item, or the other way round
        run = r.randint(8, 14)
        long, short = a + ["ha"] * run + b, a + ["ha"] * r.randint(1, run - 1) + b
        items += [(2 * i, " ".join(long)), (2 * i + 1, " ".join(short))]
        docs += [" ".join(pad + short + pad), " ".join(pad + long + pad), " ".join(long), " ".join(short)]
        # some windows of the text repeat a passage that the item has once
        docs.append(" ".join(pad + a + a[:10] + b + pad))
        docs.append(" ".join(pad + a + a[:10] * 2 + a[10:] + b))
    return docs, items


def test_repeated_shingles_match_brute_force():
    docs, items = repeated()
    want = brute(docs, items)
    index = decontam.ItemIndex(items)
    got = [(r, x) for r, leaks in enumerate(index.scan(docs)) for x in leaks]
    assert {(r, x[0]) for r, x in got} == want and len(got) == len(want) > 100
    far = []
    for r, (item, similarity, first, n) in got:
        words = decontam.words_of(docs[r])
        fps = [decontam.window_fingerprints(decontam.shingle_hashes(decontam.word_hashes(" ".join(ws)), 5), len(ws) - 4)[0]
               for ws in (words[first:first + n], decontam.words_of(dict(items)[item]))]
        far.append(int(np.bitwise_count(fps[0] ^ fps[1])))
        assert 0.8 <= similarity <= 1
    assert max(far) > decontam.RADIUS


def test_word_hashes_follow_the_words(monkeypatch):
    """One hash a word, equal for equal words wherever they stand, at any slice size."""
    r = random.Random(8)
    bits = ["a", "ab", "AB", "ba", "É", "é", "ΑΣ", "ας", "ασ", "İ", "_", "9", "٣", "日本", "\U0001f600", "'", "-", " ", "\n", "\u00a0", "\x1c", "\u0307"]
    texts = ["", " ", "x", "ΑΣ'Α ΑΣ' Σ"] + ["".join(r.choices(bits, k=r.randint(1, 80))) for _ in range(400)]
    seen, back = {}, {}
    for size in (1 << 18, 5):
        monkeypatch.setattr(decontam, "SLICE", size)
        for t in texts:
            words, hashes = decontam.words_of(t), decontam.word_hashes(t).tolist()
            assert len(words) == len(hashes), t
            for w, h in zip(words, hashes, strict=True):
                assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_items_are_packed_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PACK_BYTES", 400)
    items = spark.createDataFrame([(i, f"item number {i} has its own nine words here {i}") for i in range(40)], "item_id int, text string")
    assert len(list(decontam._packs(items, "item_id", "text", 5, 0.8))) == 5
    docs = spark.createDataFrame([(7, "so item number 7 has its own nine words here 7 it says")], "doc_id int, text string")
    assert [r.item_id for r in decontam.find_leaks(docs, items).collect()] == [7]
