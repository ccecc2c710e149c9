"""SimHash near-duplicates by multi-index hashing.

A text's words are the runs between ASCII white space, A-Z lower-cased; its features are
the XXH64 values (seed 42) of its word shingles, repeats included.  A fingerprint bit is
set if it is set in over half of the features.

Two fingerprints within ``radius`` bits differ by at most ``r_i`` bits in at least one
segment, whenever ``sum(r_i + 1) > radius``.  So each distinct fingerprint is stored once
per segment under its exact value and looks up the Hamming ball of ``r_i`` around that
value; the complete distance of every match is then verified.  With 64 bits, radius 4 and
3 segments this is 46 lookups in tables of 2^21 or 2^22 slots.

A slot with more than ``BUCKET`` fingerprints (a large family of near copies) is not
joined pair by pair.  Its members meet in blocks, and each pair of blocks yields a
spanning forest of its links, so a fingerprint makes at most as many rows as its slot has
blocks and components are the same.  In a slot of more than ``BLOCKS`` blocks the members
meet halfway instead: each visits all points within half the radius of its whole
fingerprint (2,081 for radius 4), and all that visit a point are linked to the smallest of them.  Two
fingerprints within the radius have such a point between them, and those at one point are within
the radius, so components are the same again, and rows are at most 2,081 a fingerprint
whatever the size of the family.  Exact copies share one fingerprint and never meet each
other at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from xxhash import xxh64_intdigest

from cardlake.llm.components import connected_components
from cardlake.llm.schemas import extended
from cardlake.session import cut

SEED = 42
#: a slot with more fingerprints than this is linked in blocks
BUCKET = 512
#: fingerprints per block of such a slot
BLOCK = 16_384
#: in a slot of more blocks than this, fingerprints meet halfway instead
BLOCKS = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a whole text; null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 32_768):
        bits = np.unpackbits(h[i:i + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprints(keyed: DataFrame, text_col: str, shingle: int = 4) -> DataFrame:
    """``keyed`` with its text column replaced by ``fp``, the fingerprint as a signed long."""
    keep = [c for c in keyed.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(text_col)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    schema = extended(StructType([f for f in keyed.schema if f.name != text_col]), ("fp", LongType()))
    return keyed.mapInArrow(run, schema)


def segment_radii(radius: int, segments: int) -> list[int]:
    """Ball radius of each segment, as small as the pigeonhole bound allows."""
    segments = min(segments, radius + 1)
    spare = radius + 1 - segments
    return [spare // segments + (i < spare % segments) for i in range(segments)]


def _tables(radius: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, mask, ball masks) of each segment; the widest segments get the smallest balls."""
    radii = segment_radii(radius, segments)
    m = len(radii)
    widths = sorted(64 // m + (i < 64 % m) for i in range(m))
    out, shift = [], 0
    for width, r in zip(widths, radii, strict=True):
        ball = [sum(1 << p for p in c) for k in range(r + 1) for c in combinations(range(width), k)]
        out.append((shift, (1 << width) - 1, ball))
        shift += width
    return out


def _slots(fps: DataFrame, tables, balls: bool) -> DataFrame:
    """(seg, slot, fp) rows: the exact value of each segment, or its whole ball."""
    def slot(shift: int, mask: int) -> Column:
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask).cast("long"))

    keys = [F.struct(F.lit(i).alias("seg"), slot(s, mask).bitwiseXOR(F.lit(x).cast("long")).alias("slot"))
            for i, (s, mask, ball) in enumerate(tables) for x in (ball if balls else [0])]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.seg", "k.slot", "fp")


def spanning_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within ``radius`` bits among distinct fingerprints."""
    rest, links = fps.view(np.uint64), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            near = np.bitwise_count(rest ^ p) <= radius
            if near.any():
                hit = rest[near]
                links += [(int(p.view(np.int64)), int(x)) for x in hit.view(np.int64)]
                todo.extend(hit)
                rest = rest[~near]
    return links


def visited_points(fps: DataFrame, radius: int) -> DataFrame:
    """(point, fp, inner) of every point within half of ``radius`` (rounded up) of each
    distinct fingerprint; ``inner``: within half rounded down."""
    def masks(k: int) -> list[int]:
        return [m - (1 << 64) if m >> 63 else m for c in combinations(range(64), k) for m in [sum(1 << p for p in c)]]

    def ring(distances: range, inner: bool) -> Column:
        around = F.lit([m for k in distances for m in masks(k)]).cast("array<bigint>")
        return F.transform(around, lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("point"), F.lit(inner).alias("inner")))

    half = radius // 2
    points = ring(range(half + 1), True)
    if radius % 2:
        points = F.concat(points, ring(range(half + 1, half + 2), False))
    return fps.select("fp", F.explode(points).alias("p")).select("p.point", "fp", "p.inner")


def meet_halfway(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) links within ``radius`` bits that connect exactly what all such links among the
    distinct fingerprints ``fp`` connect.  At a point, the smallest fingerprint of those within half
    the radius rounded down is within ``radius`` of all others there."""
    points = visited_points(fps, radius)
    # points that a single fingerprint visits, nearly all, end in the partial counts
    shared = points.groupBy("point").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("inner"), F.col("fp"))).alias("a")).where("n > 1 and a is not null")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return (points.select("point", F.col("fp").alias("b")).join(shared.select("point", "a"), "point")
            .where((F.col("a") != F.col("b")) & near).select("a", "b").distinct())


def link_fingerprints(fps: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp`` that join exactly the fingerprints
    connected by distances of at most ``radius`` bits: every link, except that a crowded
    slot gives a spanning forest of its links, and a huge one links by way of points between."""
    tables = _tables(radius, segments)
    exact, probes = _slots(fps, tables, False), _slots(fps, tables, True)
    crowded = cut(exact.groupBy("seg", "slot").count().where(F.col("count") > BUCKET).select("seg", "slot"))
    busy = bool(crowded.take(1))
    index = exact.join(crowded, ["seg", "slot"], "left_anti") if busy else exact
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    links = (index.withColumnRenamed("fp", "b").join(probes.withColumnRenamed("fp", "a"), ["seg", "slot"])
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))
    if not busy:
        return links

    members = cut(probes.join(crowded, ["seg", "slot"]))
    blocks = cut(members.groupBy("seg", "slot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb")))
    huge = blocks.where(F.col("nb") > BLOCKS)
    if huge.take(1):
        family = members.join(huge, ["seg", "slot"], "left_semi").select("fp").distinct()
        links = links.unionAll(meet_halfway(family, radius))
        blocks = blocks.where(F.col("nb") <= BLOCKS)
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    others = F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: j != F.col("own")))
    met = (members.join(blocks, ["seg", "slot"]).withColumn("own", own)
           .withColumn("other", F.explode(others))
           .select("seg", "slot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(pdf["fp"].to_numpy(np.int64), radius), columns=["a", "b"], dtype="int64")

    return links.unionAll(met.groupBy("seg", "slot", "i", "j").applyInPandas(forest, "a bigint, b bigint"))


def fingerprint_components(keyed: DataFrame, id_col: str, radius: int, segments: int) -> DataFrame:
    """(fp, label, component_id): ``label`` names the component of each distinct
    fingerprint, ``component_id`` is the smallest id among its rows (null: all are)."""
    ids = cut(keyed.groupBy("fp").agg(F.min(id_col).alias("low")))
    links = link_fingerprints(ids.select("fp"), radius, segments)
    comp = connected_components(links, "a", "b").withColumnRenamed("node", "fp")
    labelled = ids.join(comp, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lows = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    return cut(labelled.select("fp", "label").join(lows, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    radius: int = 4, segments: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 lower-case hex digits) and
    ``component_id`` (the smallest id whose fingerprint is reachable over links of at most
    ``radius`` differing bits, its own included).

    Null, empty and wordless texts have fingerprint zero and link like any other; a text
    of fewer words than ``shingle`` is one feature.  Repeated ids and rows keep one row
    each.  Null ids get a row and a component, but never name one unless all ids of the
    component are null.  Other columns are ignored, whatever their names; an empty table
    gives no rows."""
    keyed = cut(add_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle))
    comp = fingerprint_components(keyed, "id", radius, segments)
    return keyed.join(comp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
             segments: int = 3) -> DataFrame:
    """The row of the smallest id of each component, with all its columns; of equal ids
    the one with the lowest text key, of equal texts the one with the lowest hash of its
    whole row, and one of fully repeated rows.  Null ids come last.
    Components are those of ``near_duplicates``; only narrow keys are grouped, and texts
    move once, in the join that fetches the kept rows."""
    key = F.xxhash64(F.col(text_col), F.length(text_col)).alias("key")
    # maps cannot be hashed as they are
    whole = F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in ((f"`{c}`", t) for c, t in docs.dtypes))).alias("whole")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), key, whole)
    keyed = cut(add_fingerprints(docs.select(F.col(id_col).alias("id"), key, whole, F.col(text_col).alias("text")), "text", shingle))
    comp = fingerprint_components(keyed, "id", radius, segments)
    rows = keyed.groupBy("id", "key", "whole", "fp").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "whole", "n")).alias("p")
    picks = cut(rows.join(comp, "fp").groupBy("label").agg(best).select("p.id", "p.key", "p.whole", "p.n"))
    kept = packed.alias("d").join(picks.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.key") == F.col("p.key"))
                                  & (F.col("d.whole") == F.col("p.whole")))
    kept = kept.select("d.row", "d.id", "d.key", "d.whole", "p.n")
    if picks.where("n > 1").take(1):
        kept = kept.where("n = 1").unionAll(kept.where("n > 1").dropDuplicates(["id", "key", "whole"]))
    return kept.select("row.*")
