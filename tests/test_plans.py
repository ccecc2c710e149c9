"""Physical-plan properties the scale design relies on: columns
pruned and filters pushed into the Parquet scan, partial aggregation before the
shuffle, a partial top-k before the shuffle, no whole-group percentile buffer."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.collect()  # the adaptive plan is final once run
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_and_pushes(spark):
    p = _plan(spark, "prefix_filter")
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in p
    assert "StringStartsWith(p_name,small)" in p


def test_renest_aggregates_before_shuffle(spark):
    p = _plan(spark, "renest_two_level")
    assert "partial_collect_list" in p


def test_topk_limits_before_shuffle(spark):
    p = _plan(spark, "topk_typed")
    assert "WindowGroupLimit" in p and "Partial" in p


def test_median_without_group_buffer(spark):
    import re

    p = _plan(spark, "latency_by_category").lower()
    assert not re.search(r"\b(percentile|median)\(", p)
