import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import ann, queries
from cardlake.session import table


def brute(rows, asked, k):
    """Exact result by comparing everything, sums in the order of the components."""
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    sizes = [len(v) for _, v in ok]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s)) if ok else 0
    ok = [(i, v) for i, v in ok if len(v) == dim]
    out = {}
    x = np.array([v for _, v in ok])
    ids = np.array([i for i, _ in ok])
    for i, v in ok:
        if asked(i):
            s = ann.dots(np.repeat(v[None], len(x), 0), x)
            for j, score in zip(ids.tolist(), s.tolist()):
                if j != i:
                    out.setdefault(i, {})[j] = max(score, out.get(i, {}).get(j, -np.inf))
    return {i: sorted(((-s, j) for j, s in d.items()))[:k] for i, d in out.items()}


def as_dict(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({j for _, j in got.get(i, [])} & {j for _, j in w}) / len(w) for i, w in want.items()])


@pytest.mark.parametrize("sf, blocks", [("sf0.01", 1 << 21), ("sf0.1", 20_000)])
def test_recall_and_exact_scores(spark, monkeypatch, sf, blocks):
    monkeypatch.setattr(ann, "BLOCK", blocks)
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, path, "embeddings").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    df = queries.QUERIES["op2_ann"](spark, path)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = as_dict(df)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    exact = brute(rows, lambda i: i % 20 == 0, len(rows))
    assert all(set(g) <= set(exact[i]) and g == sorted(g) for i, g in got.items())
    assert recall(got, want) >= 0.9


def test_all_cells_give_the_exact_result(spark, monkeypatch):
    """With every cell visited the result is brute force, whatever the partitions: ties,
    copies, clusters, uneven norms."""
    rng = np.random.default_rng(3)
    v = [*(rng.normal(size=8) * rng.uniform(0.1, 3) for _ in range(150)), *([np.ones(8)] * 60), *(np.eye(8)[i % 8] * 2 for i in range(40))]
    rows = [(int(i), [float(x) for x in w]) for i, w in zip(rng.permutation(len(v)), v)]
    want = brute(rows, lambda i: i % 5 == 0, 7)
    for parts, block in ((1, 1 << 21), (5, 150)):
        monkeypatch.setattr(ann, "BLOCK", block)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        assert as_dict(ann.nearest(df, F.col("vec_id") % 5 == 0, 7, recall=1.0)) == want


def test_fewer_candidates_than_asked(spark):
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert as_dict(ann.nearest(df, F.lit(True), 20)) == brute(rows, lambda i: True, 20)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (2, [0.5, 0.5]), (10, [1.0, 0.0]), (10, [0.0, 9.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, h1 int, score int")
    first = df.where("vec_id = 10").orderBy(F.xxhash64(F.col("embedding").cast("array<double>"))).first().embedding
    kept = [(i, v) for i, v in rows if i != 10 or v == first]
    assert as_dict(ann.nearest(df, F.col("vec_id") != 2, 20)) == brute(kept, lambda i: i != 2, 20)
    assert ann.nearest(df.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 5"), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_a_hot_vector_is_asked_and_kept_once(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = as_dict(ann.nearest(df, F.col("vec_id") % 20 == 0, 5)), brute(rows, lambda i: i % 20 == 0, 5)
    assert all(got[i] == want[i] for i in want if i % 3 == 0)
    assert recall(got, want) >= 0.9
    assert ann.distinct_vectors(df, "vec_id", "embedding", 6)[0].count() == 601


def test_probe_order_is_by_chance():
    rng = np.random.default_rng(2)
    d = np.linalg.qr(rng.normal(size=(5, 5)))[0][:, :4]
    index = ann.Index(d, np.tile([-1.0, -0.3, 0.4, 1.1], (4, 1)), np.zeros(4), 2.0, 0.7, np.full(4, 0.5), 1)
    q = rng.normal(size=(1, 4))
    (cells,), = [list(index.probes(q, 1.0))]
    order = cells[0]
    p = index.project(q, True)[0] * 0.7
    draws = p + rng.normal(size=(400_000, 4)) * 0.5
    code = ((draws[:, :, None] >= index.edges[None]).sum(2) * 5 ** np.arange(4)).sum(1)
    share = np.bincount(code, minlength=625)[order] / len(code)
    assert len(order) == 625 and np.all(np.diff(share) < 0.01)
    (short,), = [list(index.probes(q, 0.5))]
    assert abs(np.cumsum(share)[len(short[0]) - 1] - 0.5) < share[0] + 0.02


def clustered(n, seed=4):
    """Vectors in tight clusters of 50, so that the work of a query need not grow with n."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 50, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = np.repeat(centres, 50, 0) + rng.normal(size=(n // 50 * 50, 16)) * 0.02
    return [(i, [float(x) for x in w]) for i, w in enumerate(v)]


def test_projections_follow_the_number_of_vectors(spark, monkeypatch):
    assert [ann.projections_for(n) for n in (0, 1, 10_000, 625 * ann.CELL)] == [4] * 4
    assert ann.projections_for(625 * ann.CELL + 1) == 5 and ann.projections_for(10 ** 10) == 10
    monkeypatch.setattr(ann, "CELL", 1)  # six projections, cut beginnings
    monkeypatch.setattr(ann, "BLOCK", 10_000)
    rows = clustered(6_000)
    assert ann.projections_for(len(rows)) == 6
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = as_dict(ann.nearest(df, F.col("vec_id") % 20 == 0, 20)), brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_shuffled_rows_grow_with_the_data(spark, monkeypatch):
    """Vectors are sent once a table, in all about twice the rows for twice the data.  A query
    visits somewhat more of the finer cells, so its part is above twice, and below the four
    times of comparing with all."""
    monkeypatch.setattr(ann, "CELL", 2)
    monkeypatch.setattr(ann, "BLOCK", 10_000)
    sent = []
    for n in (4_000, 8_000, 16_000):
        df = spark.createDataFrame(clustered(n), "vec_id long, embedding array<double>")
        vectors, _ = ann.distinct_vectors(df, "vec_id", "embedding", 21)
        index = ann.fit(vectors, 20, projections=ann.projections_for(n))
        asked, members = ann.keyed(vectors.where("ids[0] % 20 = 0").drop("ids"), vectors, index, n, 1 - 0.06 ** (1 / 6))
        sent.append((members.count(), asked.count()))
    for (m0, a0), (m1, a1) in zip(sent, sent[1:]):
        assert m1 == 2 * m0 and m1 + a1 <= 2.2 * (m0 + a0) and a1 < 3 * a0, sent


def test_likeliest_cells_of_many_projections():
    rng = np.random.default_rng(8)
    share = rng.dirichlet(np.full(5, 0.5), size=7)
    chance = {}
    for c in range(5 ** 7):
        chance[c] = np.prod([share[i][c // 5 ** i % 5] for i in range(7)])
    every = ann.likeliest(share, 1.0)
    assert sorted(every.tolist()) == list(range(5 ** 7))
    for aim in (0.1, 0.374, 0.8):
        some = ann.likeliest(share, aim)
        own = np.array([chance[c] for c in some.tolist()])
        assert len(set(some.tolist())) == len(some) and np.all(np.diff(own) <= 1e-15)
        assert own.sum() >= aim - 1e-9 > own[:-1].sum() - 1e-9
