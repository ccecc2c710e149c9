import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import quality, queries, toxicity
from cardlake.session import table

SF = "/root/testdata/sf0.1"


def crc(i):
    return zlib.crc32(str(i).encode())


def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable")
    n1 = y.sum()
    return (rank[y].sum() - n1 * (n1 - 1) / 2) / (n1 * (~y).sum())


@pytest.fixture(scope="module")
def results(spark):
    """(rows by doc_id, labels by doc_id) of both queries."""
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    return {q: queries.QUERIES[q](spark, SF).collect() for q in ("op9_quality", "op10_toxicity")}, labels


@pytest.mark.parametrize("query, label, mod, rest", [("op9_quality", "quality", 3, 1), ("op10_toxicity", "toxic", 5, 0)])
def test_held_out_accuracy(results, query, label, mod, rest):
    rows, labels = results[0][query], results[1]
    assert sorted(r.doc_id for r in rows) == list(range(10_000))
    assert all(r.held_out == (crc(r.doc_id) % mod == rest) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id][label] == 1 for r in held])
    s = np.array([r.score for r in held])
    assert auc(y, s) > 0.95
    assert np.mean((s >= 0.5) == y) > 0.95


def test_scores_do_not_depend_on_labels_of_held_out_rows(spark, results):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    hid = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(hid, 1 - F.col("quality")).otherwise(F.col("quality")))
    got = {r.doc_id: r.score for r in quality.classify(docs.repartition(3), flipped.repartition(2)).collect()}
    assert got == pytest.approx({r.doc_id: r.score for r in results[0]["op9_quality"]}, abs=1e-9)


def test_features_match_counting_by_hand():
    texts = ["a b a", "", "A!! A!! x1", "é " * 3000]
    r, f, v = quality.features(texts)
    assert np.all(np.diff(r) >= 0) and set(r) == {0, 1, 2, 3}
    for i, t in enumerate(texts):
        words = t.split()
        own = f[r == i]
        assert len(set(own)) == len(own) and v[r == i][own == quality.DIM - 1].tolist() == [1.0]
        pairs = list(zip(words, words[1:]))
        shares = sorted(np.sqrt([words.count(w) / len(words) for w in set(words)] + [pairs.count(p) / len(pairs) for p in set(pairs)]))
        have = v[r == i].tolist()
        for x in shares:
            assert any(abs(x - y) < 1e-12 for y in have)
        assert np.sum(np.square(have)) == pytest.approx(1 + 2 * bool(words) + 2 * bool(pairs))
    assert [quality.shape(w) for w in ("Word,", "WORD!!", "x12", "I", "***", "Été")] == ["Aa,", "AA!!", "a0", "Aa", "***", "Aa"]


def test_ftrl_update_is_the_published_one():
    rng = np.random.default_rng(0)
    state, z, n = quality.Ftrl.new(), np.zeros(6), np.zeros(6)
    for _ in range(50):
        x, y = rng.normal(size=6), float(rng.integers(0, 2))
        w = np.array([0.0 if abs(zi) <= quality.L1 else -(zi - np.sign(zi) * quality.L1) / ((quality.BETA + ni ** 0.5) / quality.ALPHA + quality.L2)
                      for zi, ni in zip(z, n)])
        p = 1 / (1 + np.exp(-w @ x))
        for i in range(6):
            g = (p - y) * x[i]
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
        state.update(np.arange(6), x, y)
    assert state.z[:6] == pytest.approx(z) and state.n[:6] == pytest.approx(n)


def test_training_separates_confirmed_texts():
    rng = np.random.default_rng(1)
    words = ["good", "fine", "worthless", "stupid", "calm"]
    texts = [" ".join(rng.choice(words[2:] if i < 20 else words, 12)) for i in range(60)]
    toxic = np.arange(60) < 20
    w, b = toxicity.train(texts, toxic, 0.3)
    r, f, v = toxicity.features(texts)
    z = np.bincount(r, w[f] * v, minlength=60) + b
    assert z[toxic].mean() > z[~toxic].mean()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", 0.3), (None, None, 0.1), (1, "", 0.2), (2, "w " * 50_000, 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        assert {r.score for r in quality.classify(docs, lab).collect()} == {0.5}
        assert len({r.score for r in toxicity.classify(docs, lab).collect()}) == 1
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, "bad bad ### words" if i % 2 else "good calm words here") for i in range(40)] * 2, "doc_id long, text string")
    rows = [(i, 1 - i % 2, i % 2) for i in range(40)] * 3 + [(3, 1, 0), (3, None, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 80 and all(r.predicted == 1 - r.doc_id % 2 for r in got)
    assert [r.doc_id is not None for r in got].count(True) == 80
    assert toxicity.classify(docs, labels).count() == 80


def test_add_scores_replaces_a_clashing_column(spark):
    docs = spark.createDataFrame([(1, "x", 9)], "doc_id long, text string, Score int")
    out = quality.add_scores(docs, np.zeros(quality.DIM))
    assert out.columns == ["doc_id", "text", "score"] and out.first().score == 0.5
