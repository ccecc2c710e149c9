"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner
product.

Vectors are lifted to equal length (a last component fills up the norm; queries are scaled
to that length), so the largest inner product is the smallest distance.  Each of several
tables cuts a few Gaussian projections (made orthogonal) into slots, ``floor((a.x + b) / w)``
with the outer slots open; the slots of one table are a cell.

Fitting measures, over all vectors, how far true neighbours of a few queries lie from them
along a projection.  With that, a cell's chance to hold a neighbour of a query is a product
over its projections.  A query visits the cells of each table in the order of that chance,
from its own cell through perturbed ones, until their sum reaches the chance that makes the
tables together find ``recall`` of the neighbours.

The number of projections of a table follows the number of vectors, so that a cell holds
about as many whatever their number.

Equal vectors are indexed once with their smallest ids, and asked once.  Cells are dealt to
blocks of bounded size, crowded ones split; queries go only to blocks whose cells they
visit, in as many turns as the queries of that block need, and a block that none visits is
not shuffled.  A block keeps the best of each query with scores summed in a fixed order, so the
result does not depend on how rows are dealt.  The tables' candidates are merged and
ranked by these exact scores.  Where neighbours are near, rows grow with the vectors and
the queries.  Uniformly random vectors have no near neighbours to speak of: there most
cells must be visited to find nine of ten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardlake.llm.joins import measured_broadcast
from cardlake.session import cut

TABLES = 6
#: projections of a table, at the least
PROJECTIONS = 4
SLOTS = 5
#: vectors a cell holds on average, at the most
CELL = 2_048
#: width of a slot, in standard deviations of a projection
WIDTH = 0.85
#: bounds of the sample for the spread and of the queries for the neighbours' distance
SAMPLE = 2_048
FIT_QUERIES = 64
#: components of the vectors, and of the queries, that meet in one task
BLOCK = 1 << 21


@dataclass
class Index:
    """Fitted hash functions: directions (dim + 1, tables x projections), the slot edges of
    each, the length all vectors are lifted to, and the neighbours' spread."""

    directions: np.ndarray
    edges: np.ndarray
    mean: np.ndarray
    length: float
    slope: float
    spread: np.ndarray
    tables: int = TABLES

    @property
    def per_table(self) -> int:
        return self.directions.shape[1] // self.tables

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        if query:
            lifted = np.column_stack([x * (self.length / norm)[:, None], np.zeros(len(x))])
        else:
            lifted = np.column_stack([x, np.sqrt(np.maximum(self.length ** 2 - norm ** 2, 0))])
        return lifted @ self.directions

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell of each vector in each table."""
        p = self.project(x, False)
        slots = (p[:, :, None] >= self.edges[None]).sum(2)
        base = SLOTS ** np.arange(self.per_table)
        return (slots.reshape(len(x), self.tables, self.per_table) * base).sum(2)

    def probes(self, x: np.ndarray, chance: float) -> Iterator[list[np.ndarray]]:
        """For each query the cells to visit in each table, in the order of their chance,
        until it sums to ``chance``; all cells from 1 on."""
        from math import erf

        p = self.project(x, True)
        centre = self.mean + self.slope * (p - self.mean)
        z = (self.edges[None] - centre[:, :, None]) / (self.spread[None, :, None] * np.sqrt(2))
        below = 0.5 * (1 + np.vectorize(erf, otypes=[float])(z))
        share = np.diff(np.concatenate([np.zeros((*below.shape[:2], 1)), below, np.ones((*below.shape[:2], 1))], 2), axis=2)
        for s in share:
            yield [likeliest(s[t * self.per_table:(t + 1) * self.per_table], chance) for t in range(self.tables)]


def likeliest(share: np.ndarray, chance: float) -> np.ndarray:
    """The cells of one table in the order of their chance, until it sums to ``chance``; all
    of them from 1 on.  ``share``: for each projection the chance of each slot.  Beyond
    ``PROJECTIONS`` projections, only the likeliest beginnings of cells are carried on, fewer
    with each projection; together they always hold more than ``chance``."""
    likely, code = np.ones(1), np.zeros(1, np.int64)
    late = len(share) - PROJECTIONS
    for i, own in enumerate(share):
        likely = np.outer(own, likely).ravel()
        code = (np.arange(SLOTS)[:, None] * SLOTS ** i + code).ravel()
        step = i - PROJECTIONS + 2
        if step > 0 and i + 1 < len(share) and chance < 1:
            held = np.argsort(-likely, kind="stable")
            enough = chance + (1 - chance) * (1 - step / (late + 1))
            held = np.sort(held[:int(np.searchsorted(np.cumsum(likely[held]), enough)) + 1])
            likely, code = likely[held], code[held]
    order = np.argsort(-likely, kind="stable")
    n = len(order) if chance >= 1 else int(np.searchsorted(np.cumsum(likely[order]), chance)) + 1
    return code[order[:n]]


def projections_for(n_vectors: int) -> int:
    """Projections of a table at which a cell holds at most ``CELL`` of ``n_vectors`` on average."""
    return max(PROJECTIONS, ceil(log(max(n_vectors, 1) / CELL, SLOTS)))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    total = np.zeros(len(q))
    for i in range(q.shape[1]):
        total += q[:, i] * x[:, i]
    return total


def best(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], lists: Iterator[tuple[np.ndarray, np.ndarray]],
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best ids of each query row among the rows of ``x``;
    ``lists`` gives (query rows, vector rows) that meet, each pair once."""
    scale = float(np.sqrt((q * q).sum(1)).max(initial=0) * np.sqrt((x * x).sum(1)).max(initial=0))
    slack = 1e-12 * scale  # rounding of products in blocks is far below
    floor = np.full(len(q), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0

    def pack() -> None:
        nonlocal n
        a, b, s = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((-s, a))
        a, b, s = a[order], b[order], s[order]
        start = np.searchsorted(a, np.arange(len(q)))
        rank = np.arange(len(a)) - start[a]
        last = np.flatnonzero(rank == k - 1)
        floor[a[last]] = s[last] - slack
        keep = s >= floor[a]
        held[:] = [(a[keep], b[keep], s[keep])]
        n = int(keep.sum())

    for rows, members in lists:
        for lo in range(0, len(rows), 1024):
            r = rows[lo:lo + 1024]
            s = q[r] @ x[members].T
            i, j = np.nonzero(s >= floor[r][:, None])
            held.append((r[i], members[j], s[i, j]))
            n += len(i)
            if n > 4 * k * len(q) + (1 << 18):
                pack()
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pack()
    a, b, _ = held[0]
    s = np.concatenate([dots(q[a[i:i + 65_536]], x[b[i:i + 65_536]]) for i in range(0, len(a), 65_536)] or [np.zeros(0)])
    each = np.fromiter((len(ids[v]) for v in b), np.int64, len(b))
    a, s, v = np.repeat(a, each), np.repeat(s, each), np.concatenate([ids[v] for v in b] or [np.zeros(0, np.int64)])
    order = np.lexsort((v, -s, a))
    a, s, v = a[order], s[order], v[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], v[keep], s[keep]


def distinct_vectors(rows: DataFrame, id_col: str, vec_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, vec, ids) of each distinct usable vector, with its ``keep`` smallest ids,
    and (id, h1, h2) of each id; of several vectors of an id that with the smallest hash."""
    vec = F.col(vec_col).cast("array<double>")
    usable = (rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
              .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
              .where(F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
                     & F.exists("vec", lambda x: x != 0)))
    sizes = usable.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    usable = usable.where(F.size("vec") == (sizes["dim"] if sizes else 0))
    keyed = usable.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    named = keyed.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("v")).select("id", "v.h1", "v.h2")
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    ids = (named.withColumn("r", rank).where(F.col("r") <= keep).groupBy("h1", "h2")
           .agg(F.sort_array(F.collect_list("id")).alias("ids")))
    vectors = keyed.groupBy("h1", "h2").agg(F.any_value("vec").alias("vec"))
    return cut(vectors.join(ids, ["h1", "h2"])), named


def _stack(column) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column], float)


def true_best(queries: np.ndarray, vectors: DataFrame, k: int) -> DataFrame:
    """(query, score, vec) of the ``k`` best vectors of a few queries by comparing with all,
    partition by partition; the queries travel with the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _stack(b.column("vec").to_pylist())
            s = queries @ x.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(queries)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s[q, top.ravel()]), b.column("vec").take(pa.array(top.ravel()))],
                                             names=["query", "score", "vec"])

    found = vectors.select("vec").mapInArrow(run, "query bigint, score double, vec array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def fit(vectors: DataFrame, k: int, tables: int = TABLES, projections: int = PROJECTIONS, seed: int = 7) -> Index | None:
    """Hash functions fitted to distinct vectors: the length over all of them, the spread
    from the ``SAMPLE`` that come first by their hash, and the distance of neighbours along
    a projection from the true neighbours, among all, of ``FIT_QUERIES`` of these."""
    length = vectors.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if not length:
        return None
    sample = _stack(r.vec for r in vectors.orderBy("h1", "h2").limit(SAMPLE).select("vec").collect())
    rng = np.random.default_rng(seed)
    dim, n = sample.shape[1] + 1, tables * projections
    parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ceil(n / dim))]
    index = Index(np.concatenate(parts, 1)[:, :n], np.zeros((n, SLOTS - 1)), np.zeros(n), length, 1.0, np.ones(n), tables)
    p = index.project(sample, False)
    index.mean, sd = p.mean(0), np.maximum(p.std(0), 1e-9 * length)
    shift = rng.uniform(-0.5, 0.5, n)
    index.edges = index.mean[:, None] + (WIDTH * sd)[:, None] * (np.arange(SLOTS - 1) - (SLOTS - 2) / 2 + shift[:, None])
    asked = sample[:FIT_QUERIES]
    near = true_best(asked, vectors, k + 1).toPandas()  # at most FIT_QUERIES x (k + 1) rows
    at, found = near["query"].to_numpy(), _stack(near["vec"])
    other = (found != asked[at]).any(1)
    if other.any():
        a = (index.project(asked, True)[at[other]] - index.mean) / sd
        b = (index.project(found[other], False) - index.mean) / sd
        index.slope = float(np.clip((a * b).sum() / max((a * a).sum(), 1e-12), 0, 1))
        index.spread = sd * max(float((b - index.slope * a).std()), 1e-6)
    else:
        index.spread = sd
    return index


def keyed(queries: DataFrame, vectors: DataFrame, index: Index, n_vectors: int, chance: float) -> tuple[DataFrame, DataFrame]:
    """Queries and vectors under the keys (tab, block, part, turn) by which they meet: a
    vector once for each table and turn of its block, a query once for each block that it
    visits and each part of that."""
    room = max(1, BLOCK // len(index.directions))  # rows
    blocks = max(1, ceil(n_vectors / room))
    tables = index.tables
    where = "tab int, block bigint"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_stack(b.column("vec").to_pylist()))
            rows = pa.array(np.repeat(np.arange(b.num_rows), tables))
            tab = np.tile(np.arange(tables), b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tab, pa.int32()), pa.array(cells.ravel() % blocks), pa.array(cells.ravel()),
                 *(b.column(c).take(rows) for c in ("h1", "h2", "vec", "ids"))], names=["tab", "block", "cell", "h1", "h2", "vec", "ids"])

    def visits(part: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, table, block, cells) that the queries of a slice visit."""
        for i, per in enumerate(index.probes(_stack(part.column("vec").to_pylist()), chance)):
            for t, cells in enumerate(per):
                at = cells % blocks
                order = np.argsort(at, kind="stable")
                present, start = np.unique(at[order], return_index=True)
                for j, own in zip(present.tolist(), np.split(cells[order], start[1:]), strict=True):
                    yield i, t, j, own

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                at, tab, block, lists = zip(*visits(part), strict=True)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tab, pa.int32()), pa.array(block, pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                     *(part.column(c).take(rows) for c in ("h1", "h2", "vec"))], names=["tab", "block", "cells", "h1", "h2", "vec"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                pairs = np.array([(t, j) for _, t, j, _ in visits(b.slice(lo, 256))], np.int64)
                found, n = np.unique(pairs, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int32()), pa.array(found[:, 1]), pa.array(n)],
                                                 names=["tab", "block", "n"])

    members = vectors.mapInArrow(hashed, f"{where}, cell bigint, h1 bigint, h2 bigint, vec array<double>, ids array<bigint>")
    asked = queries.mapInArrow(asking, f"{where}, cells array<bigint>, h1 bigint, h2 bigint, vec array<double>")
    # a block of crowded cells is split; its queries then go to every part, in turns if they are many
    parts = members.groupBy("tab", "block").agg(F.ceil(F.count(F.lit(1)) / (2 * room)).cast("int").alias("parts"))
    turns = (queries.mapInArrow(counted, f"{where}, n bigint").groupBy("tab", "block")
             .agg(F.ceil(F.sum("n") / (2 * room)).cast("int").alias("turns")))
    shape = measured_broadcast(cut(parts.join(turns, ["tab", "block"])), 32)
    members = (members.join(shape, ["tab", "block"]).withColumn("part", F.pmod("h1", F.col("parts")).cast("int"))
               .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("parts", "turns", "h1", "h2"))
    asked = (asked.join(shape, ["tab", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("turn", F.pmod("h2", F.col("turns")).cast("int")).drop("parts", "turns"))
    return asked, members


def search(queries: DataFrame, vectors: DataFrame, index: Index, n_vectors: int, k: int, chance: float) -> DataFrame:
    """(h1, h2, vec_id, score): the ``k`` best ids found for each distinct query vector."""
    keys = ["tab", "block", "part", "turn"]
    asked, members = keyed(queries, vectors, index, n_vectors, chance)

    def meet(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return pd.DataFrame({"h1": [], "h2": [], "vec_id": [], "score": []}).astype({"h1": "int64", "h2": "int64", "vec_id": "int64"})
        q, x = _stack(ask["vec"]), _stack(have["vec"])
        cell = have["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        present, start = np.unique(cell[order], return_index=True)
        groups = dict(zip(present.tolist(), np.split(order, start[1:]), strict=True))
        size = ask["cells"].map(len).to_numpy()
        wanted = np.concatenate(ask["cells"].to_numpy())
        row = np.repeat(np.arange(len(ask)), size)
        by = np.argsort(wanted, kind="stable")
        visited, first = np.unique(wanted[by], return_index=True)
        lists = ((r, groups[c]) for c, r in zip(visited.tolist(), np.split(row[by], first[1:]), strict=True) if c in groups)
        a, v, s = best(q, x, [np.asarray(i, np.int64) for i in have["ids"]], lists, k)
        return pd.DataFrame({"h1": ask["h1"].to_numpy()[a], "h2": ask["h2"].to_numpy()[a], "vec_id": v, "score": s})

    found = asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(
        lambda ask, have: meet(have, ask), "h1 bigint, h2 bigint, vec_id bigint, score double")
    merged = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            recall: float = 0.94) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``rows`` where ``is_query`` holds, the
    ``k`` other ids found with the largest inner product (double precision, summed in the
    order of the components), nearest first, ties to the smaller id; all other ids if they
    are fewer than ``k``.

    Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor rows without an id or, if lengths differ, those of all but the most frequent length
    (ties: the longer).  Repeated rows count once, of several vectors of an id the
    one with the smallest hash counts.  Other columns are ignored; an empty table gives no
    rows.

    ``recall`` is the share of true neighbours aimed at.  A query that finds fewer than
    ``k`` ids though there are more visits all cells."""
    vectors, named = distinct_vectors(rows, id_col, vec_col, k + 1)
    n = vectors.count()
    index = fit(vectors, k, projections=projections_for(n))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    asking = rows.where(is_query).select(F.col(id_col).cast("long").alias("id")).distinct()
    asked_ids = named.join(asking, "id").select(F.col("id").alias("query_id"), "h1", "h2")
    asked = cut(vectors.drop("ids").join(asked_ids.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi"))
    chance = 1 - (1 - recall) ** (1 / index.tables)
    found = cut(search(asked, vectors, index, n, k + 1, chance))
    every = named.limit(k + 1).count()
    few = asked.join(found.groupBy("h1", "h2").count().where(F.col("count") >= every).select("h1", "h2"), ["h1", "h2"], "left_anti")
    if few.take(1):
        again = search(few, vectors, index, n, k + 1, 1.0)
        found = found.join(few.select("h1", "h2"), ["h1", "h2"], "left_anti").unionAll(again.select(*found.columns))
    pairs = asked_ids.join(found, ["h1", "h2"]).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
