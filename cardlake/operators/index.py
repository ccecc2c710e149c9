"""Vector index that is brought up to date instead of built anew.

A card is known by its type, its id and a hash of its text.  Bringing the index up to a
corpus encodes only cards whose hash it does not hold yet; cards that are gone leave it.
Each type has a folder; only the folders of types in which something changed are written
again, and all become visible by one manifest (:mod:`cardlake.sources.staged`).  A typed read
opens the folder of its type alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.session import cut
from cardlake.sources.staged import read_manifest, swap_manifest

KEY = ["type", "card_id", "content_hash"]


def read_index(spark: SparkSession, path: str, types: Sequence[str] | None = None) -> DataFrame | None:
    """The indexed cards, of the given types only; None if no folder holds any."""
    _, entries = read_manifest(spark, path)
    folders = [f"{path.rstrip('/')}/{entries[t]}" for t in (entries if types is None else types) if t in entries]
    return spark.read.parquet(*folders) if folders else None


def update_index(cards: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], vec_col: str = "vec") -> DataFrame:
    """Bring the index at ``path`` up to ``cards`` ``(card_id, type, page_content, ...)`` and
    report ``(type, kept, encoded, removed)`` of every type.

    ``encode`` adds ``vec_col`` to the cards it is given.  Of cards with one type, id and text
    one is kept; cards of one id and different texts all are.  Null types and ids are left out.  Types
    are as few as a corpus has sources; their names, not their cards, reach the driver."""
    spark = cards.sparkSession
    number, entries = read_manifest(spark, path)
    wanted = cut(cards.where("type is not null and card_id is not null")
                 .withColumn("content_hash", F.sha2(F.coalesce("page_content", F.lit("")), 256)).dropDuplicates(KEY))
    old = read_index(spark, path)
    if old is None:
        fresh = wanted
        counts = wanted.groupBy("type").agg(F.lit(0).cast("long").alias("kept"), F.count(F.lit(1)).alias("encoded"), F.lit(0).cast("long").alias("removed"))
    else:
        fresh = wanted.join(old.select(KEY), KEY, "left_anti")
        both = wanted.select(*KEY, F.lit(1).alias("new")).join(old.select(*KEY, F.lit(1).alias("old")), KEY, "full")
        counts = both.groupBy("type").agg(F.count_if(F.col("new").isNotNull() & F.col("old").isNotNull()).alias("kept"),
                                          F.count_if(F.col("old").isNull()).alias("encoded"), F.count_if(F.col("new").isNull()).alias("removed"))
    report = cut(counts)
    changed = [r.type for r in report.where("encoded > 0 or removed > 0").select("type").collect()]  # names of types
    if not changed:
        return report
    rows = encode(fresh.where(F.col("type").isin(changed)))
    if old is not None:
        stays = old.where(F.col("type").isin(changed)).join(wanted.select(KEY), KEY, "left_semi")
        rows = rows.unionByName(stays.select(rows.columns))
    run = f"runs/{uuid.uuid4().hex}"
    rows.withColumn("_type", F.col("type")).write.partitionBy("_type").parquet(f"{path.rstrip('/')}/{run}")
    alive = {r.type for r in report.where("kept + encoded > 0").select("type").collect()}
    now = {t: f for t, f in entries.items() if t in alive} | {t: f"{run}/_type={_escaped(spark, t)}" for t in changed if t in alive}
    swap_manifest(spark, path, number, now)
    return report


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
