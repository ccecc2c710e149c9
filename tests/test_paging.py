"""Re-nesting in pages: a hot parent with repeated rows, pages put together again."""

import pytest
from pyspark.sql import functions as F

from cardlake.operators import nest, paging


def _rows(spark):
    hot = [(1, i % 700, "x") for i in range(4000)]  # ties, and rows repeated in full
    rest = [(k, i, f"t{i}") for k in range(2, 60) for i in range(k)]
    return spark.createDataFrame([*hot, *rest, (None, 1, "lost"), (70, None, None), (70, 3, None)], "fk long, n long, t string").repartition(5)


@pytest.mark.parametrize("page_rows", [1, 7, 1000])
def test_pages_put_together_equal_the_nested_list(spark, page_rows):
    child = _rows(spark)
    parent = spark.createDataFrame([(k, f"p{k}") for k in [*range(1, 60), 70, 99]], "id long, name string")
    pages = paging.renest_pages(parent, child, "id", "fk", ["n"], ["n", "t"], page_rows, ranges=16).persist()
    assert pages.columns == ["id", "name", "page", "first", "items"]
    assert pages.agg(F.max(F.size("items"))).first()[0] <= page_rows
    got = {r.id: r.items for r in paging.unpage(pages, "id").collect()}
    want = {r.id: r.items for r in nest.renest(parent, child, "id", "fk", ["n", "t"], ["n", "t"], "items").collect()}
    assert got == want and got[99] is None and len(got[1]) == 4000
    for r in pages.groupBy("id").agg(F.sort_array(F.collect_list("page")).alias("p"), F.sum(F.size("items")).alias("n")).collect():
        assert r.p == list(range(len(r.p))) and len(r.p) == -(-(r.n or 0) // page_rows)
    pages.unpersist()


def test_hot_parent_is_dealt_over_many_ranges(spark):
    hot = spark.range(20_000).select(F.lit(1).alias("fk"), F.lit(0).alias("n"))  # one parent, all rows equal
    pages = paging.page_children(hot, "fk", ["n"], ["n"], 500, ranges=16)
    assert sorted((r.page, r.first, len(r["items"])) for r in pages.collect()) == [(p, 500 * p, 500) for p in range(40)]
    parted = hot.select("*", F.monotonically_increasing_id().alias("s")).repartitionByRange(16, "fk", "n", "s")
    assert parted.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000


def test_no_rows_and_bad_pages(spark):
    empty = spark.createDataFrame([], "fk long, n long")
    assert paging.page_children(empty, "fk", ["n"], ["n"]).count() == 0
    with pytest.raises(ValueError):
        paging.page_children(empty, "fk", ["n"], ["n"], 0)
