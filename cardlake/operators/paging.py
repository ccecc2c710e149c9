"""Re-nesting in pages (E1-E3, A15): a parent's children as lists of bounded length.

:func:`cardlake.operators.nest.renest` gives a parent's whole list in one row, which one
task must hold.  Here the children are numbered per parent without gathering a parent:

1. a range sort over parent, order keys and fields, with a salt behind them so that equal rows
   may be parted too, deals a hot parent over as many ranges as its size asks for;
2. rows are counted per parent and range, and the counts summed up over the ranges: one
   small row per parent and range;
3. a row's number is that sum plus its place in its range, its page the number divided by
   the page's length; a page is an aggregate of at most that many rows.

The ranges come from a sample, so the sorted rows are cut before they are counted: a
repeated task reads the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardlake.session import cut


def page_children(child: DataFrame, fk: str, order_by: Sequence[str], fields: Sequence[str], page_rows: int = 1000,
                  ranges: int | None = None) -> DataFrame:
    """``(fk, page, first, items)``: the children of each parent in the order of ``order_by``, ties by
    ``fields``, ``page_rows`` a page; ``first`` is the number of the page's first child, from 0.
    Rows without a parent key are left out, as a join leaves them."""
    if page_rows < 1:
        raise ValueError("page_rows must be at least 1")
    order = list(dict.fromkeys([*order_by, *fields]))
    value = F.struct(*fields)
    rows = child.where(F.col(fk).isNotNull()).select(
        F.col(fk).alias("_fk"), F.struct(*order).alias("_o"), F.monotonically_increasing_id().alias("_salt"), value.alias("_v"))
    n = ranges or int(child.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(n, "_fk", "_o", "_salt").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("_fk").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_fk", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_fk", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_fk", "_range").orderBy("_o", "_salt"))
    numbered = rows.withColumn("_place", place).join(starts, ["_fk", "_range"]).select(
        "_fk", "_v", (F.col("_start") + F.col("_place") - 1).alias("_number"))
    page = F.floor(F.col("_number") / page_rows).cast("bigint").alias("page")
    pages = numbered.groupBy("_fk", page).agg(F.sort_array(F.collect_list(F.struct("_number", "_v"))).alias("_items"))
    return pages.select(F.col("_fk").alias(fk), "page", (F.col("page") * page_rows).alias("first"),
                        F.transform("_items", lambda e: e["_v"]).alias("items"))


def renest_pages(parent: DataFrame, child: DataFrame, key: str, fk: str, order_by: Sequence[str], fields: Sequence[str],
                 page_rows: int = 1000, ranges: int | None = None) -> DataFrame:
    """Parents as a stream of pages: one row per parent and page, its columns beside ``page``,
    ``first`` and ``items``; a parent without children has one row in which the three are null."""
    pages = page_children(child, fk, order_by, fields, page_rows, ranges).withColumnRenamed(fk, "_fk")
    return parent.join(pages, parent[key] == pages["_fk"], "left").drop("_fk")


def unpage(pages: DataFrame, key: str, out: str = "items") -> DataFrame:
    """``(key, out)``: the pages of each parent put together again; no pages give null."""
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("page", "items")))), lambda p: p["items"]))
    return pages.groupBy(key).agg(F.when(F.count("page") > 0, whole).alias(out))
