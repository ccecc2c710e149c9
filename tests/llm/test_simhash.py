import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cardlake.llm import queries, simhash
from cardlake.llm.components import connected_components
from cardlake.session import table
from tests.conftest import SF_SMALL


def brute_fingerprint(text):
    words, w = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") + " ":
        if c in "\t\n\x0b\x0c\r ":
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    a = np.array(fps, np.uint64)
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius) + i + 1:
            root[find(i)] = find(int(j))
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(n)]


def test_fingerprint_matches_brute_force():
    for t in [None, "", " \n\t", "One", "one two three", "A b c d", "Ä Straße İ x y z", "w " * 40_000,
              " ".join(f"W{i % 977}" for i in range(70_000)), "a b c d e f g"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_native_hash_agrees(spark):
    t = "the quick brown fox"
    h = spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] & (1 << 64) - 1
    assert simhash.fingerprint(t) == h


@pytest.mark.parametrize("radius, segments", [(4, 1), (4, 2), (4, 3), (4, 4), (4, 5), (2, 3), (0, 3), (6, 4)])
def test_radii_satisfy_the_pigeonhole_bound(radius, segments):
    assert sum(r + 1 for r in simhash.segment_radii(radius, segments)) == radius + 1


@pytest.mark.parametrize("bucket, block, blocks", [(512, 16_384, 16), (3, 8, 10_000), (0, 5, 10_000), (3, 8, 1)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket, block, blocks):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCKS", blocks)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 6, np.uint64)
    fps = {0}
    for c in centres:
        for k in (1, 2, 3, 4, 5, 8):
            for _ in range(8):
                x = int(c)
                for b in rng.choice(64, k, replace=False):
                    x ^= 1 << int(b)
                fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {r.node: r.label for r in connected_components(links, "a", "b").collect()}
    want = brute_components(signed, fps)
    assert [got.get(x, x) for x in signed] == want
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 4 for r in links.collect())


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_meeting_halfway_connects_what_brute_force_connects(spark, radius):
    rng = np.random.default_rng(radius)
    fps = {int(c) for c in rng.integers(0, 2**64, 3, np.uint64)}
    for c in sorted(fps):
        for _ in range(25):  # walks away from the centre in steps around the radius
            x = c
            for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    links = simhash.meet_halfway(spark.createDataFrame([(x,) for x in signed], "fp bigint"), radius)
    rows = links.collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= radius for r in rows)
    got = {r.node: r.label for r in connected_components(links, "a", "b").collect()}
    assert [got.get(x, x) for x in signed] == brute_components(signed, fps, radius)


def test_rows_of_a_huge_family_are_linear(spark):
    """Twice the fingerprints visit twice the points; blocks would have four times the pairs."""
    def visits(n):
        return simhash.visited_points(spark.range(n).select(F.col("id").alias("fp")), 4).count()

    assert [visits(n) for n in (100, 200)] == [208_100, 416_200]


def test_edge_rows(spark):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "x"), (None, "a b c d e", "x"),
            (7, None, "y"), (9, "", "y"), (8, "  \n", "y"), (None, "only one of its kind here", None),
            (5, "w " * 100_000, "z"), (5, "another text altogether with words", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components([i for i, _, _ in rows], fps)
    assert got == sorted((i is None, i or 0, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, comp))
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([("1", "a b c d e"), ("7", None), ("None", "only one of its kind here"),
                           ("5", "w " * 100_000), ("5", "another text altogether with words")], key=lambda t: (t[0], t[1]))
    assert simhash.keep_one(docs).columns == docs.columns
    empty = docs.where("false")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3, 4, 5), (2, "a b", 2, 3, 4, 5)],
                                 "doc_id long, text string, id int, key int, row int, n int")
    assert simhash.near_duplicates(docs).count() == 2
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(1, "a b", 2, 3, 4, 5)]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    fps = [brute_fingerprint(t) for _, t in docs]
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, brute_components([i for i, _ in docs], fps)))
    df = queries.QUERIES["op8_simhash"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in df.collect()) == want
