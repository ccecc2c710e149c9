"""Importance resampling towards a target distribution (hashed n-gram features).

The words of a text come from the tokenizers library's pre-tokenisation, an untrained
regular-expression split over the text with A-Z lower-cased, as words with offsets.  Pairs
of offsets span windows of consecutive words, and each window is hashed by CRC-32 into a
bucket.  The corpus's and the target's bucket histograms give every bucket a gain, a
text's weight is the sum of its windows' gains, and Gumbel noise from the id turns "draw
without replacement, by weight" into "take the highest scores".

Texts are split once: a text's windows are kept as its bucket counts, written to the
shared folder, from which the corpus histogram and then the weights are made.  Ranks come
from a range-partitioned sort and the sizes of its partitions; no task holds more than one
partition, however many documents are drawn or tied.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cardlake.session import cut

BUCKETS = 10_000
#: characters split at once, and windows whose buckets are remembered
PIECE = 1 << 16
HELD = 1 << 18

#: fixed value: what lies between words
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


@lru_cache(maxsize=1)
def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(BETWEEN), "removed")


def lowered(text: str) -> str:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut between words only."""
    start = 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:] if start else text


class Buckets(dict):
    """Bucket of a window's text, the recent ones remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, window: str) -> int:
        if len(self) >= HELD:
            self.clear()
        self[window] = got = crc32(window.encode("utf-8", "surrogatepass")) % self.size
        return got


def window_buckets(text: str, buckets: Buckets, longest: int = 1) -> tuple[int, np.ndarray]:
    """(words, bucket of every window of 1 to ``longest`` consecutive words)."""
    split = splitter().pre_tokenize_str
    found, carry, n_words = [], "", 0
    for piece in pieces(lowered(text)):
        # words of the last windows go in front of the next piece, for the windows that cross the cut
        words = split(piece)
        n_words += len(words)
        found += [buckets[w] for w, _ in words]
        if longest == 1 or not words:
            continue
        line = " ".join([carry, *(w for w, _ in words)] if carry else [w for w, _ in words])
        ends = [m.start() for m in re.finditer(" ", line)] + [len(line)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        old = carry.count(" ") + 1 if carry else 0
        for k in range(2, longest + 1):
            first_new = max(0, old - k + 1)  # the first window that ends in a new word
            found += [buckets[line[a:b]] for a, b in zip(starts[first_new:], ends[first_new + k - 1:], strict=False)]
        carry = line[starts[max(0, len(starts) - longest + 1)]:]
    return n_words, np.array(found, np.int64)


def histograms(docs: DataFrame, text_col: str, size: int, longest: int) -> DataFrame:
    """``docs`` with its text replaced by ``n_words``, ``n_features`` and ``counts``: the buckets
    of the text's windows and how often each occurs, as unsigned 32-bit integers."""
    kept = [c for c in docs.columns if c != text_col]
    at, others = docs.columns.index(text_col), [docs.columns.index(c) for c in kept]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("n_words", LongType()), StructField("n_features", LongType()),
                         StructField("counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(size)
        for b in batches:
            words, features, counts = [], [], []
            for t in b.column(at):
                n, found = window_buckets(t.as_py() or "", buckets, longest)
                own, times = np.unique(found, return_counts=True)
                words.append(n)
                features.append(len(found))
                counts.append(np.concatenate([own, times]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(words, pa.int64()), pa.array(features, pa.int64()),
                                              pa.array(counts, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def totals(counted: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each bucket in all texts; at most ``size`` rows a task and in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for c in b.column(0):
                own, times = np.frombuffer(c.as_py(), "<u4").reshape(2, -1)
                total[own] += times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(size, np.int64)
    for r in counted.select("counts").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + size) / ((s + 1)(T + size)))) of every bucket, in doubles."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def add_weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``counted`` with its ``counts`` replaced by ``weight``, the sum of its windows' gains."""
    kept = [c for c in counted.columns if c != "counts"]
    at, others = counted.columns.index("counts"), [counted.columns.index(c) for c in kept]
    shared = counted.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = []
            for c in b.column(at):
                own, times = np.frombuffer(c.as_py(), "<u4").astype(np.int64).reshape(2, -1)
                weights.append(int(shared.value[own] @ times))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(weights, pa.int64())], names=[*kept, "weight"])

    return counted.mapInArrow(run, StructType([*(counted.schema[c] for c in kept), StructField("weight", LongType())]))


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             percent: int = 10, min_words: int = 20, seed: int = 2024, longest: int = 1, size: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_features``, ``weight``, ``score`` and ``rank``, which
    counts the drawn documents by falling score from 1 and is null for the others.

    Drawn are ``percent`` of the documents with at least ``min_words`` words (rounded down).
    Ties go to the smaller id, a null id last; rows that are still equal are interchangeable.  Null, empty and
    wordless texts have no features, weight 0 and are never drawn unless ``min_words`` is 0;
    they count in no histogram.  A null id has the noise of an empty id.  Repeated rows are rows of their own; other columns
    are ignored; an empty table gives no rows, an empty target gains from smoothing alone."""
    counted = cut(histograms(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", size, longest)
                  .withColumn("row", F.monotonically_increasing_id()))
    gain = gains(totals(counted, size), totals(histograms(target.select(F.col(target_text_col).alias("text")), "text", size, longest), size))
    scored = add_weights(counted, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    # sorted in ranges; ``row`` only spreads rows that are equal otherwise
    ranged = (scored.where(F.col("n_words") >= min_words)
              .repartitionByRange(F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight", "row")
              .sortWithinPartitions(F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight", "row")
              .withColumn("place", F.monotonically_increasing_id()))
    placed = cut(ranged.select("id", "n_features", "weight", "score", F.shiftright("place", 33).cast("int").alias("range"),
                               F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")))
    sizes = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    first, n = [], 0
    for k, own in sizes:
        first.append((k, n))
        n += own
    drawn = percent * n // 100
    offsets = placed.sparkSession.createDataFrame(first, "range int, before bigint")
    rank = F.col("before") + F.col("nth") + 1
    ranked = placed.join(F.broadcast(offsets), "range").select(  # one row a range
        "id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    short = scored.where(F.col("n_words") < min_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionAll(short).withColumnRenamed("id", id_col)
