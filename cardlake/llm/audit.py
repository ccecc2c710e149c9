"""Audit of how quality filters interact, by a Gray-code walk over their subsets.

Every document gets a mask of the filters it fails, and a part's documents are counted by
mask: 32 cells for five filters, whatever the corpus holds.  The walk visits all subsets
of filters, toggling one filter at a time: each cell keeps a counter of the active filters
it fails, and leaves or joins the running survivors as that counter leaves or reaches
zero.  The 32 states are stored, and every step of every order of the filters is a
difference of two of them.

Masks, copies and counts are Spark aggregates; only cells, one row a part, reach the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.session import cut

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
#: the mask bit of the filter that looks at other documents
COPY = 1 << FILTERS.index("E")
#: parts whose rows are made at once
PARTS = 64

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COLUMNS)


def text_mask(docs: DataFrame) -> DataFrame:
    """(id, part, key, mask): the filters each text of (id, part, text) fails by itself, and
    a digest of the text."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    parts = docs.select(
        "id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), words.alias("words"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("capitals"), F.length("text").alias("chars"),
        F.col("text").rlike(r"[#$%&*|]").alias("signs"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    fails = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"),
             100 * F.col("capitals").cast("long") > 2 * F.col("chars").cast("long"), F.col("signs")]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return parts.select("id", "part", "key", mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part by the filters they fail.

    Copies of a text are counted before they meet: rows of one text, part and labels make
    one row with the smallest id among them, so no copy group is gathered."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = text_mask(rows).groupBy("id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    marked = own.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    lowest = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    alike = cut(marked.groupBy("part", "key", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), lowest.alias("low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed")))
    first = (alike.groupBy("key").agg(F.min("low.id").alias("first"), F.sum("n").alias("copies"))
             .where("copies > 1").drop("copies"))
    at_first = F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(F.lit(0))
    later = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.col("n") - F.col("unnamed") - at_first)
    split = alike.join(first, "key", "left").withColumn("later", later).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", (F.col("n") - F.col("later")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), F.col("later").alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def walk(counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters: ``counts`` and the result are (part, mask or
    subset, measure)."""
    failing = np.zeros(STATES, np.int64)  # active filters that each cell fails
    running = counts.sum(axis=1)
    out = np.zeros_like(counts)
    out[:, 0] = running
    masks, subset = np.arange(STATES), 0
    for i in range(1, STATES):
        bit = i & -i
        subset ^= bit
        touched = masks[masks & bit > 0]
        if subset & bit:
            running = running - counts[:, touched[failing[touched] == 0]].sum(axis=1)
            failing[touched] += 1
        else:
            failing[touched] -= 1
            running = running + counts[:, touched[failing[touched] == 0]].sum(axis=1)
        out[:, subset] = running
    return out


#: every step of every order: order, step, filter, subset before
STEPS = [("".join(o), k + 1, FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k]))
         for o in permutations(FILTERS) for k in range(len(FILTERS))]


def report(states: np.ndarray) -> list[np.ndarray]:
    """The columns of all steps, each (part, step), as differences of the stored states."""
    which = np.array([s[2] for s in STEPS])
    before = np.array([s[3] for s in STEPS])
    after = before | 1 << which
    lost = states[:, before] - states[:, after]
    kept, removed = states[:, after, 0], lost[:, :, 0]
    single = 1 << np.arange(len(FILTERS))
    fails = states[:, [0], 0] - states[:, single, 0]
    unique = states[:, STATES - 1 - single, 0] - states[:, [STATES - 1], 0]
    shapley = np.stack([removed[:, which == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return [kept, removed, fails[:, which] - removed, unique[:, which], lost[:, :, 1], lost[:, :, 2], shapley[:, which]]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with document counts of the part:
    ``kept`` after the step, ``removed`` by it, ``redundant`` (fails its filter but was removed
    earlier), ``unique_fails`` (fails its filter only), ``good_lost`` and ``toxic_lost`` (removed
    here and so labelled) and ``shapley`` (removed by its filter over all orders).

    Filters: A under 200 words, B under half of the words distinct, C over 2 % of the
    characters A-Z, D a sign of ``#$%&*|``, E a text that a smaller id has too.  A null text
    is empty, a null part the empty string.  A null id is neither smaller nor larger than
    others: it fails E never and has no label; rows with one id and text do not fail E by each other.  Every row counts,
    repeated ones too.  An id with several labels is good (toxic) if any says so.  Other
    columns are ignored; an empty table gives no rows."""
    per_part = (cells(docs, labels, id_col, text_col, part_col).groupBy("part")
                .agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = pa.array([s[0] for s in STEPS]), pa.array([s[1] for s in STEPS], pa.int32())
        for b in batches:
            for lo in range(0, b.num_rows, PARTS):
                own = b.slice(lo, PARTS)
                counts = np.zeros((own.num_rows, STATES, 3), np.int64)
                for i, row in enumerate(own.column(1).to_pylist()):
                    for c in row:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                measures = report(walk(counts))
                at = np.repeat(np.arange(own.num_rows), len(STEPS))
                step = pa.array(np.tile(np.arange(len(STEPS)), own.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0).take(pa.array(at)), orders.take(step), steps.take(step), *(pa.array(m.ravel()) for m in measures)],
                    names=["part", "filter_order", "step", *COLUMNS])

    return per_part.mapInArrow(run, SCHEMA)
