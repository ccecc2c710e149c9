"""Line dedup by site-relative frequency, DataFrame functions only.

A line's ratio is the share of its host's pages that contain it; lines over the ratio are
boilerplate and go.  Pages of one host with the same text count once, on both sides of the
division, so copies of a page do not turn its own lines into boilerplate.  With ``near``
the same holds for near copies: pages of one host whose word shingles are that similar
(Jaccard) form families, and a family counts once.

Families come from a sketch of each page, its ``SKETCH`` smallest shingle hashes, from which
the similarity of two pages is estimated (at 0.8 with a standard deviation of 0.05).  Pages
that share one of their ``KEYS`` smallest hashes are each compared with the first page of that
slot, so pairs grow with the pages, not with the square of a family; the links' components
are the families.  A site's template fills slots whose first page is any page of the site,
but it is one and the same page for all of them, and ``KEYS`` leaves enough slots for what a
page has of its own: where unrelated pages are not similar themselves (a template of up to
85 %), 0.98-similar pairs are found with a recall over 0.9.

Lines and pages are counted by 128-bit hashes: the exploded rows are narrow, the distinct
step and the counts aggregate before they shuffle, and no text is moved.  The boilerplate
set of a host holds at most (mean distinct lines of a page / ratio) lines; it is fetched by
one join on the host, broadcast only if its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.llm.components import connected_components
from cardlake.llm.joins import measured_broadcast
from cardlake.session import cut

#: words of a shingle, hashes of a sketch, and how many of them are looked up
SHINGLE = 3
SKETCH = 64
KEYS = 32


def _hashes(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def families(pages: DataFrame, near: float) -> DataFrame:
    """(page, family): the pages, given as (host, page, text), that have near copies on
    their host, and the smallest page of their family."""
    words = F.col("words")
    shingles = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, SHINGLE))))
    sketches = cut(pages.select("host", "page", F.split(F.lower(F.trim("text")), r"\s+").alias("words"))
                   .select("host", "page", F.slice(F.array_sort(F.array_distinct(shingles)), 1, SKETCH).alias("sketch"))
                   .dropDuplicates(["page"]))
    slots = sketches.select("host", "page", F.explode(F.slice("sketch", 1, KEYS)).alias("key")).select(F.xxhash64("host", "key").alias("slot"), "page")
    firsts = slots.groupBy("slot").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").drop("last")
    pairs = slots.join(firsts, "slot").where("page <> first").select("page", "first").distinct()
    both = (pairs.join(sketches.select("page", F.col("sketch").alias("a")), "page")
            .join(sketches.select(F.col("page").alias("first"), F.col("sketch").alias("b")), "first"))
    lowest = F.slice(F.array_sort(F.array_union("a", "b")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("a", "b"), lowest))
    links = both.where(shared >= near * F.size(lowest)).select("page", "first")
    return cut(connected_components(links, "page", "first").select(F.col("node").alias("page"), F.col("label").alias("family")))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, near: float | None = None) -> DataFrame:
    """(host, h1, h2): hashes of the trimmed lines over the ratio, one row per host."""
    p1, p2 = _hashes(F.col("text"))
    pages = (docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
             .where("host is not null and text is not null").select("host", "text", p1.alias("p1"), p2.alias("p2")))
    l1, l2 = _hashes(F.col("line"))
    lines = (pages.select("host", "p1", "p2", F.explode(_lines(F.col("text"))).alias("line"))
             .select("host", "p1", "p2", F.trim("line").alias("line")).where("line <> ''")
             .select("host", l1.alias("l1"), l2.alias("l2"), "p1", "p2"))
    pages_of = pages.select("host", "p1", "p2")
    if near is not None:
        page = F.xxhash64("host", "p1", "p2")
        known = families(pages.select("host", page.alias("page"), "text"), near)
        known = measured_broadcast(known, 16)
        lines, pages_of = (x.withColumn("page", page).join(known, "page", "left").drop("page")
                           .withColumns({"p1": F.coalesce("family", "p1"), "p2": F.when(F.col("family").isNull(), F.col("p2")).otherwise(F.lit(0))})
                           .drop("family") for x in (lines, pages_of))
    totals = pages_of.distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = lines.distinct().groupBy("host", "l1", "l2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    over = lines.join(totals, "host").where(F.col("n") / F.col("total") > ratio)
    return over.groupBy("host").agg(F.collect_set("l1").alias("h1"), F.collect_set("l2").alias("h2"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.02,
                     min_pages: int = 3, counts: tuple[str, str] | None = None, near: float | None = None) -> DataFrame:
    """``docs`` with its boilerplate lines dropped from ``text_col``; with ``counts``, the
    lines before and the dropped lines are added under these two names.

    A line is boilerplate if it is on more than ``ratio`` of its host's distinct pages and
    on at least ``min_pages`` of them.  With ``near``, pages of a host whose estimated similarity
    is at least that, and those they are linked to by such pages, count as one page.  Lines are compared without surrounding spaces; lines
    of spaces only are never boilerplate.  The lines kept stay as they were, in order; a
    page with no line left has the empty text.  A null text stays null, an empty one empty.
    Rows without a host are left as they are.  Repeated rows stay, other columns pass
    through whatever their names; an empty table gives no rows."""
    sets = cut(boilerplate(docs, host_col, text_col, ratio, min_pages, near))
    sets = measured_broadcast(sets, 64 + F.octet_length("host") + 8 * (F.size("h1") + F.size("h2")))
    packed = docs.select(F.struct("*").alias("row"), F.col(host_col).alias("host"), _lines(F.col(text_col)).alias("lines"))
    h1, h2 = (lambda x: _hashes(F.trim(x))[0]), (lambda x: _hashes(F.trim(x))[1])
    kept = F.when(F.col("h1").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~(
        F.array_contains("h1", h1(x)) & F.array_contains("h2", h2(x)))))
    out = packed.join(sets, "host", "left").select("row", "lines", kept.alias("kept"))
    fields = [F.col("row")[c].alias(c) if c != text_col else F.array_join("kept", "\n").alias(c) for c in docs.columns]
    if counts:
        fields += [F.coalesce(F.size("lines"), F.lit(0)).alias(counts[0]),
                   F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias(counts[1])]
    return out.select(*fields)
