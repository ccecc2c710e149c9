"""One key holding a third of all rows: the operators built for hot keys give the same
answers as a plain pandas restatement (partial aggregation, no whole-group buffer)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cardlake.operators import lookup, quality, retrieve


def _skewed(spark, n=30_000):
    rng = np.random.default_rng(11)
    key = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 2_000, n))
    pdf = pd.DataFrame({"k": key.astype("int64"), "ord": rng.permutation(n).astype("int64"),
                        "v": rng.normal(size=n), "text": [f"t{x % 50}" for x in rng.integers(0, 10_000, n)]})
    return spark.createDataFrame(pdf).repartition(8), pdf


def test_pick_one_hot_key(spark):
    df, pdf = _skewed(spark)
    for last in (False, True):
        got = {r.k: r.ord for r in lookup.pick_one(df, "k", ["ord"], ["ord"], last=last).collect()}
        want = (pdf.groupby("k")["ord"].max() if last else pdf.groupby("k")["ord"].min()).to_dict()
        assert got == want


def test_unique_and_not_null_hot_key(spark):
    df, pdf = _skewed(spark)
    res = {(r.column_name, r.test): r.failures for r in quality.run_suite(
        {"t": df}, [quality.Spec("t", "k", ("not_null", "unique")), quality.Spec("t", "v", ("not_null",))]).collect()}
    dup = int((pdf.groupby("k").size() > 1).sum())
    assert res == {("k", "unique"): dup, ("k", "not_null"): 0, ("v", "not_null"): 0}


def test_content_ids_hot_text(spark):
    df, pdf = _skewed(spark)
    cards = df.select(F.col("ord").alias("card_id"), F.col("text").alias("page_content"))
    got = {r.card_id: r.content_id for r in retrieve.content_ids(cards).collect()}
    first = pdf.groupby("text")["ord"].min()
    assert got == {o: int(first[t]) for o, t in zip(pdf["ord"], pdf["text"])}


def test_knn_hot_type(spark):
    """A third of all cards share one type: typed top-k through both plans equals brute force."""
    rng = np.random.default_rng(5)
    n, dim = 3_000, 16
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    types = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c"], n))
    rows = [(int(i), str(t), [float(x) for x in v]) for i, (t, v) in enumerate(zip(types, m))]
    cards = spark.createDataFrame(rows, "card_id long, type string, vec array<float>")
    qs = spark.createDataFrame(rows[::7], "qid long, qtype string, qvec array<float>")
    mf = np.array([r[2] for r in rows], dtype=np.float32).astype(np.float64)
    for bcast, block in ((None, 4096), (0, 256)):
        got = {}
        for r in retrieve.knn(qs, cards, 3, typed=True, block_rows=block, broadcast_bytes=bcast).collect():
            got.setdefault(r.qid, []).append((r.rank, r.card_id))
        for qid, t, _ in rows[::7]:
            s = mf @ mf[qid]
            want = sorted((-s[j], j) for j in range(n) if types[j] == t)[:3]
            assert [c for _, c in sorted(got[qid])] == [j for _, j in want], (bcast, qid)
