"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as sparse dot products.

Words are the runs between white space, long runs in pieces.  A text's features are its word unigrams and
bigrams and those of the words' shapes (letters by case, digits, signs as they are, a mark
for a word that repeats the one before); each family is hashed into the weight vector, and
a feature's value is the square root of its share of the family.

A bounded sample of the labelled rows is dealt to shards of bounded size.  Each shard is
one task that runs the sequential updates over its rows, and the shards' weights are
averaged (parameter mixing).  Every text is scored whole, in place, against the broadcast
weights, whose size is that of the hash space.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from cardlake.llm.schemas import extended
from cardlake.session import cut

#: size of the weight vector; the last weight is the bias
DIM = 1 << 18
#: bound of the labelled ids learnt from, and how many of them make a shard
SAMPLE = 24_576
SHARD_ROWS = 4_096
#: texts learnt from of one id
TEXTS = 4
EPOCHS = 3
#: updates: learning rate, its smoothing, and the two penalties
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
#: characters of the texts whose features are made together
SLICE = 1 << 20

#: a longer run between white space (a line of a script without spaces, say) is cut into words of this size
LONGEST = 64

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[\W_]+")
_SAME = re.compile(r"((.)\2{3})\2+", re.S)
_LONG = re.compile(rf"\S{{{LONGEST + 1}}}")


def words_of(text: str) -> list[str]:
    """Runs between white space, long ones in pieces: every character is in some word."""
    words = text.split()
    if _LONG.search(text):
        words = [w[i:i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def shape(word: str) -> str:
    """``Word,`` gives ``Aa,``, ``WORD!!`` gives ``AA!!``, ``x12`` gives ``a0``; a sign stands at most
    four times in a row."""
    return "".join(("0" if t[0].isdigit() else "a" if t.islower() else "AA" if len(t) > 1 and t.isupper() else "Aa") if t[0].isalnum() else _SAME.sub(r"\1", t)
                   for t in _TOKEN.findall(word))


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Slot of 64-bit hashes in the weight vector, by one family's salt."""
    x = (h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(29)) % np.uint64(DIM - 1)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of all features of the texts, ordered by row; the bias included."""
    words = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    distinct = list(set().union(*words)) if words else []
    code = {w: i for i, w in enumerate(distinct)}
    ids = np.fromiter((code[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    own = np.fromiter((xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))
    form = np.fromiter((xxh64_intdigest(shape(w).encode("utf-8", "surrogatepass")) for w in distinct), np.uint64, len(distinct))
    row = np.repeat(np.arange(len(words)), sizes)
    inner = row[1:] == row[:-1]
    h, s = own[ids], form[ids]
    s[1:][inner & (ids[1:] == ids[:-1])] ^= np.uint64(0x5851F42D4C957F2D)
    rows, slots, values = [np.arange(len(words))], [np.full(len(words), DIM - 1)], [np.ones(len(words))]
    for k, x in enumerate((h, s)):
        pair = (x[:-1] * np.uint64(0x2545F4914F6CDD1D) + x[1:])[inner]
        for salt, r, v in ((2 * k + 1, row, x), (2 * k + 2, row[1:][inner], pair)):
            key, n = np.unique(r * DIM + _mix(v, salt), return_counts=True)
            total = np.bincount(r, minlength=len(words))
            rows.append(key // DIM)
            slots.append(key % DIM)
            values.append(np.sqrt(n / total[key // DIM]))
    r, f, v = map(np.concatenate, (rows, slots, values))
    order = np.argsort(r, kind="stable")
    return r[order], f[order], v[order]


def slices(texts: Iterable[str], size: int = SLICE) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together, at least one each."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


@dataclass
class Ftrl:
    """State of the updates: accumulated gradients ``z`` and squared gradients ``n``."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> Ftrl:
        return cls(np.zeros(DIM), np.zeros(DIM))

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float) -> None:
        """One example, its slots in ``slots`` (equal ones add up)."""
        w = self.weights(slots)
        g = (sigmoid(w @ values) - label) * values
        root = np.sqrt(self.n[slots])
        sigma = (np.sqrt(self.n[slots] + g * g) - root) / ALPHA
        np.add.at(self.z, slots, g - sigma * w)
        np.add.at(self.n, slots, g * g)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights after ``EPOCHS`` passes over the rows, in the order given."""
    state = Ftrl.new()
    made = []
    for part in slices(texts):
        r, f, v = features(part)
        at = np.searchsorted(r, np.arange(len(part) + 1))
        f, v = f.astype(np.int32), v.astype(np.float32)
        made += [(f[a:b].copy(), v[a:b].copy()) for a, b in zip(at[:-1], at[1:], strict=True)]
    for _ in range(EPOCHS):
        for (f, v), y in zip(made, labels, strict=True):
            state.update(f, v, y)
    return state.weights()


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; a null id does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))


def lowest_ids(rows: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of (id, ...), one an id, whose ids have the lowest hashes.  Only rows
    under a threshold that leaves a few times as many reach the one task that ends the order."""
    rows = rows.withColumn("h", F.xxhash64("id"))
    n = rows.count()
    share = min(1.0, 4 * size / max(1, n))
    while share < 1.0:
        part = cut(rows.where(F.col("h") < F.lit(int((share - 0.5) * 2.0**64))))
        if part.count() >= size:
            return cut(part.orderBy("h", "id").limit(size).drop("h"))
        share *= 4
    return cut(rows.orderBy("h", "id").limit(size).drop("h"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, mod: int, rest: int,
                    size: int) -> tuple[DataFrame, int]:
    """(id, text, y) of the ``size`` labelled ids, not held out, that come first by their
    hash, and how many these are.  An id with several labels has their mean; null labels
    and ids are no labels.  Of an id with several texts the ``TEXTS`` distinct ones that
    come first by their hash are learnt from, so the sample's rows are bounded too."""
    ids = lowest_ids(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
           .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"), mod, rest))
           .groupBy("id").agg(F.avg("y").alias("y")), size)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = (texts.join(F.broadcast(ids), "id")  # at most ``size`` ids
                .groupBy("id", "y", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.first("text").alias("text")))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("h", "h2"))
    return distinct.withColumn("nth", nth).where(F.col("nth") <= TEXTS).select("id", "text", "y"), ids.count()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        mod: int = 3, rest: int = 1, size: int = SAMPLE) -> np.ndarray:
    """Weight vector learnt from at most ``size`` labelled ids that are not held out."""
    sample, n = labelled_sample(docs, labels, label_col, id_col, text_col, mod, rest, size)
    shards = max(1, -(-n // SHARD_ROWS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "text"], kind="stable")
        w = train(pdf["text"].tolist(), pdf["y"].to_numpy(float))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": at, "w": w[at]})

    key = F.xxhash64("id", F.lit(1))
    learnt = (sample.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "text", "y")
              .groupBy("shard").applyInPandas(shard, "slot bigint, w double"))
    got = learnt.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()  # at most DIM rows
    weights = np.zeros(DIM)
    weights[got["slot"].to_numpy(np.int64)] = got["w"].to_numpy(float) / shards
    return weights


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    for part in slices(texts):
        r, f, v = features(part)
        out.append(sigmoid(np.bincount(r, weights[f] * v, minlength=len(part))))
    return np.concatenate(out)


def add_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text in ``score_col`` (a
    column of that name is replaced).  Null and empty texts score the bias alone."""
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(float)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                texts, n = [], 0
                while lo + len(texts) < b.num_rows and n < SLICE:
                    texts.append(b.column(at)[lo + len(texts)].as_py() or "")
                    n += len(texts[-1])
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, len(texts)).columns, pa.array(score_texts(texts, w))], names=[*kept, score_col])
                lo += len(texts)

    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    return rows.mapInArrow(run, extended(rows.schema, (score_col, DoubleType())))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             mod: int = 3, rest: int = 1, size: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out`` (crc32 of the id as text leaves
    ``rest`` modulo ``mod``), ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Only the text enters a score.  Held-out ids are never learnt from, nor null ids or null
    labels; an id with several labels has their mean.  Without any label every score is
    0.5.  Null and empty texts score the bias.  Null and repeated ids and rows keep a row
    each; other columns are ignored; an empty table gives no rows."""
    weights = fit(docs, labels, label_col, id_col, text_col, mod, rest, size)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return add_scores(rows, weights).select(
        F.col("id").alias(id_col), held_out(F.col("id"), mod, rest).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
