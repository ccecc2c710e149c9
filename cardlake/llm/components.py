"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., 2014).  Every step is joins and partial aggregates over the edges, so a
hub with a third of all edges is a skewed join against one row, which AQE splits, never a
collected neighbour list.  Each round is cut with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.session import cut


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): every node of an edge, labelled with the smallest node of its
    component.  Self-loops, repeated edges and both directions are allowed; rows with a
    null end are ignored; no edges give no rows."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    e = cut(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct())
    seen = _signature(e)
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        e = cut(small)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
