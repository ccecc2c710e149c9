"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Numpy linear models are trained from confirmed toxic texts and unlabelled ones; a text is
never taken as harmless because a label says so.  With the share ``prior`` of toxic texts,
the risk is ``prior * P+ + max(0, U- - prior * P-)``: the loss of unlabelled texts as
negatives, corrected by what the toxic ones among them account for.  When the corrected
part falls below zero the model has begun to learn the unlabelled texts by heart, and the
step goes back up that part instead.

Features are a text's distinct lower-cased words and their prefixes, hashed; a feature's
value is about the percentage of the distinct words that have it.  Toxic and unlabelled rows are bounded samples, dealt to shards of bounded
size; each shard is one task that trains one model, and their weights are averaged.
Every text is scored whole, in place, against the broadcast weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from xxhash import xxh64_intdigest

from cardlake.llm.quality import held_out, labelled_sample, sigmoid, slices
from cardlake.llm.schemas import extended

DIM = 1 << 18
PREFIXES = (4, 5, 6, 7)
#: bounds of the confirmed and the unlabelled ids learnt from, and how many make a shard
POSITIVES = 4_096
UNLABELLED = 8_192
SHARD_ROWS = 6_144
#: a feature must be in this many of a shard's texts, and this many standard errors more or
#: less frequent in its confirmed texts than in its unlabelled ones
MIN_TEXTS = 5
APART = 5.0
#: steps, batches, Adam's rate, penalty, size of a step back up
EPOCHS, BATCHES, RATE, L2, GAMMA = 100, 4, 0.1, 1e-5, 1.0
#: distinct words whose features are remembered
HELD = 1 << 18

_WORD = re.compile(r"[^\W\d_]+")


def word_slots(word: str) -> list[int]:
    """Slots of a lower-cased word and of its proper prefixes."""
    grams = [f"={word}", *(word[:k] for k in PREFIXES if len(word) > k)]
    return [xxh64_intdigest(g.encode("utf-8", "surrogatepass")) % DIM for g in grams]


def distinct_words(text: str, parts: dict[str, list[str]]) -> set[str]:
    """Distinct lower-cased words of a text; ``parts`` remembers the words of each run
    between white space."""
    out: set[str] = set()
    for unit in set(text.split()):
        words = parts.get(unit)
        if words is None:
            words = parts[unit] = _WORD.findall(unit.lower())
        out.update(words)
    return out


def weight(n_words: int) -> float:
    """Value of one distinct word: its share in percent, held down in very short texts."""
    return 100.0 / (n_words + 20)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value), ordered by row."""
    rows, slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    parts: dict[str, list[str]] = {}
    known: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        words = distinct_words(t, parts)
        found: list[int] = []
        for w in words:
            s = known.get(w)
            if s is None:
                s = known[w] = word_slots(w)
            found += s
        f, n = np.unique(np.array(found, np.int64), return_counts=True)
        rows.append(np.full(len(f), i))
        slots.append(f)
        values.append(n * weight(len(words)))
        if len(parts) > HELD:
            parts.clear()
            known.clear()
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic loss of margins and its derivative."""
    return np.logaddexp(0, -z), -sigmoid(-z)


def train(texts: list[str], toxic: np.ndarray, prior: float, seed: int = 0) -> tuple[np.ndarray, float]:
    """(weights, bias) of one model; ``toxic`` marks the confirmed texts, the others are
    unlabelled.  Without texts of both kinds there is no model: zero weights, bias by prior."""
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not toxic.any() or toxic.all():
        return np.zeros(DIM), start
    counts, base = np.zeros((2, DIM)), 0
    for part in slices(texts):
        r, f, _ = features(part)
        for k in (0, 1):
            counts[k] += np.bincount(f[toxic[r + base] == bool(k)], minlength=DIM)
        base += len(part)
    n_texts = np.array([[(~toxic).sum()], [toxic.sum()]])
    share = counts / n_texts
    both = (counts.sum(0) + 1) / (n_texts.sum() + 2)
    apart = np.abs(share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / n_texts).sum())
    good = (apart >= APART) & (counts.sum(0) >= MIN_TEXTS)
    made, base = [], 0
    for part in slices(texts):
        r, f, v = features(part)
        keep = good[f]
        made.append((r[keep] + base, f[keep], v[keep]))
        base += len(part)
    r, f, v = (np.concatenate(x) for x in zip(*made, strict=True))
    used, f = np.unique(f, return_inverse=True)
    at = np.searchsorted(r, np.arange(len(texts) + 1))
    w, bias = np.zeros(len(used)), start
    m, s, step = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0
    rng = np.random.default_rng(seed)
    p_rows, u_rows = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    for _ in range(EPOCHS):
        for p, u in zip(np.array_split(rng.permutation(p_rows), BATCHES), np.array_split(rng.permutation(u_rows), BATCHES), strict=True):
            if not len(p) or not len(u):
                continue
            batch = np.concatenate([p, u])
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in batch])
            local = np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
            fi, vi = f[take], v[take]
            z = np.bincount(local, w[fi] * vi, minlength=len(batch)) + bias
            zp, zu = z[:len(p)], z[len(p):]
            (lp, gp), (ln, gn), (lu, gu) = loss(zp), loss(-zp), loss(-zu)
            rest = lu.mean() - prior * ln.mean()
            d = np.zeros(len(batch))
            sign = 1.0
            if rest >= 0:
                d[:len(p)] += prior * gp / len(p)
            else:
                sign = -GAMMA
            d[:len(p)] += sign * prior * gn / len(p)
            d[len(p):] += sign * -gu / len(u)
            grad = np.append(np.bincount(fi, d[local] * vi, minlength=len(w)) + L2 * w, d.sum())
            step += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
    out = np.zeros(DIM)
    out[used] = w
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        mod: int = 5, rest: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        prior: float | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) from the confirmed ids that come first by their hash, at most
    ``positives``, and as many as ``unlabelled`` ids of ``docs`` as such; held-out ids are
    in neither.  ``prior`` defaults to the share of toxic ids among all labelled ids that
    are not held out."""
    known = (labels.select(F.col(id_col).alias(id_col), F.col(label_col).cast("double").alias("y"))
             .where(F.col(id_col).isNotNull() & F.col("y").isNotNull() & ~held_out(F.col(id_col), mod, rest))
             .groupBy(id_col).agg(F.avg("y").alias("y")))
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0] or 0.0
    sure = known.where("y > 0.5").select(id_col, F.lit(1).alias("y"))
    some = docs.select(id_col).distinct().withColumn("y", F.lit(0))
    first, n = labelled_sample(docs, sure, "y", id_col, text_col, mod, rest, positives)
    others, m = labelled_sample(docs, some, "y", id_col, text_col, mod, rest, unlabelled)
    sample, shards = first.unionAll(others), max(1, -(-(n + m) // SHARD_ROWS))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "key", "text"], kind="stable")
        w, bias = train(pdf["text"].tolist(), pdf["y"].to_numpy() > 0.5, prior)
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(at, DIM), "w": np.append(w[at], bias)})

    key = F.xxhash64("id", F.lit(1))
    learnt = (sample.select(F.pmod(key, F.lit(shards)).alias("shard"), key.alias("key"), "text", "y")
              .groupBy("shard").applyInPandas(shard, "slot bigint, w double"))
    got = learnt.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()  # at most DIM + 1 rows
    weights = np.zeros(DIM + 1)
    weights[got["slot"].to_numpy(np.int64)] = got["w"].to_numpy(float) / shards
    return weights[:DIM], float(weights[DIM])


class Scorer:
    """Probability of toxicity of whole texts, with what is known of recent words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.parts: dict[str, list[str]] = {}
        self.known: dict[str, float] = {}

    def margin(self, text: str) -> float:
        words = distinct_words(text, self.parts)
        total = 0.0
        for w in words:
            v = self.known.get(w)
            if v is None:
                v = self.known[w] = float(self.weights[word_slots(w)].sum())
            total += v
        if len(self.parts) + len(self.known) > HELD:
            self.parts.clear()
            self.known.clear()
        return self.bias + total * weight(len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        return sigmoid(np.fromiter(map(self.margin, texts), float, len(texts)))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
             mod: int = 5, rest: int = 0, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
             prior: float | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``held_out`` (crc32 of the id as text leaves
    ``rest`` modulo ``mod``), ``score`` (0 to 1, higher: toxic likelier) and ``predicted``.

    Only the text enters a score.  Held-out, null and unlabelled-as-toxic ids are never
    learnt from as toxic; an id with several labels is confirmed if their mean is over one
    half.  Without confirmed or without unlabelled texts every score is the prior.  Null,
    empty and wordless texts score the bias.  Null and repeated ids and rows keep a row
    each; other columns are ignored; an empty table gives no rows."""
    weights, bias = fit(docs, labels, label_col, id_col, text_col, mod, rest, positives, unlabelled, prior=prior)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            got = scorer.scores([t.as_py() or "" for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got)], names=["id", "score"])

    scored = rows.mapInArrow(run, extended(rows.select("id").schema, ("score", DoubleType())))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), mod, rest).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
