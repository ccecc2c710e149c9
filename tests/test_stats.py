"""Exact bounded-memory quantiles against numpy on skewed groups, ties and tiny
buckets that force several narrowing passes.

Operators: E11.
"""

import numpy as np
import pytest

from cardlake.operators.stats import exact_quantile


def _numpy(values, q):
    return float(np.quantile(np.array(values, dtype=np.float64), q, method="linear"))


@pytest.mark.parametrize("q,buckets,max_exact", [(0.5, 4, 3), (0.5, 4096, 100_000), (0.25, 3, 1), (0.9, 2, 5),
                                                 (0.0, 4, 2), (1.0, 4, 2)])
def test_exact_quantile_matches_numpy(spark, q, buckets, max_exact):
    rng = np.random.default_rng(7)
    rows = []
    # one hot group with a third of the rows, heavy ties, a constant group, a single row,
    # a group of NULLs only, negative and clustered values
    hot = np.round(rng.lognormal(0, 2, 600), 1)
    rows += [("hot", float(x)) for x in hot]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 300)]
    rows += [("const", 5.0)] * 50
    rows += [("one", -3.5)]
    rows += [("nulls", None)] * 4
    rows += [("clustered", float(x)) for x in 1e6 + rng.normal(0, 1e-6, 400)]
    rows += [("mixed", None), ("mixed", 2.0), ("mixed", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.quantile for r in exact_quantile(df, ["g"], "v", q=q, buckets=buckets, max_exact=max_exact)
           .collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vals in groups.items():
        assert got[g] == pytest.approx(_numpy(vals, q), rel=1e-12, abs=1e-12), g


def test_median_matches_spark_median(spark):
    from pyspark.sql import functions as F

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = {r.event_type: r.m for r in ev.groupBy("event_type").agg(F.median("value").alias("m")).collect()}
    got = {r.event_type: r.quantile for r in exact_quantile(ev, ["event_type"], "value", buckets=8,
                                                                 max_exact=20).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12), k


@pytest.mark.parametrize("max_exact, buckets", [(100_000, 4096), (5, 4), (1, 2)])
def test_every_double_is_ordered(spark, max_exact, buckets):
    """NaN counts as the largest value, infinities and values of any size are ordinary."""
    nan, inf = float("nan"), float("inf")
    groups = {"nan": [1.0, 2.0, nan], "inf": [1.0, 2.0, inf, -inf, 3.0] * 5, "huge": [1e308, -1e308, 1e-308, 5e-324, 0.0, -0.0, -5e-324],
              "same": [inf] * 9, "mostly": [nan, nan, 1.0], "zeros": [0.0, -0.0] * 4, "none": [None, 4.0], "spread": [10.0 ** k for k in range(-300, 300, 7)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.75, 1.0):
        got = {r.k: r.m for r in exact_quantile(df, ["k"], "v", q, "m", buckets=buckets, max_exact=max_exact).collect()}
        for k, vs in groups.items():
            s = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
            h = (len(s) - 1) * q
            lo, hi = s[int(h)], s[min(len(s) - 1, int(h) + (h > int(h)))]
            want = lo if h == int(h) or lo == hi else lo + (h - int(h)) * (hi - lo)
            assert got[k] == want or (got[k] != got[k] and want != want) or abs(got[k] - want) <= 1e-12 * abs(want), (k, q)
