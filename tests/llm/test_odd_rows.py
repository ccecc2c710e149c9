"""Column names and types, repeated ids and damaged inputs that other tests do not have."""

import gzip
import os

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cardlake.llm import bpe, decontam, linededup, quality, simhash, tokencount, toxicity, warc

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with columns whose types cannot be spelled without quoting."""
    rows = [(i, f"some words of text number {i} here", "s", (i, {"a b": i}), {"k": i}) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra struct<`my field`:int,`x,y`:map<string,int>>, `a map` map<string,int>")
    return docs.withColumn("key id", F.struct(F.col("doc_id").alias("my id")))


@pytest.mark.parametrize("apply", [
    lambda d: quality.add_scores(d, np.zeros(quality.DIM)), lambda d: bpe.encode_decode(d, PATH), lambda d: simhash.keep_one(d),
    lambda d: linededup.drop_boilerplate(d), lambda d: decontam.drop_leaks(d, d.select(F.col("doc_id").alias("item_id"), F.lit("none of it").alias("text")))])
def test_columns_of_any_type_pass_through(odd, apply):
    out = apply(odd)
    types = dict(out.dtypes)
    assert [types[c] for c in odd.columns] == [t for _, t in odd.dtypes]
    assert out.count() == (1 if "keep_one" in str(apply) else 6) or out.count() <= 6
    assert {(r.doc_id, r.extra["my field"], r.extra["x,y"]["a b"]) for r in out.collect()} <= {(i, i, i) for i in range(6)}


def test_ids_of_any_type(odd):
    docs = odd.withColumn("text", F.lit("one two three four five six"))
    items = docs.select(F.col("key id").alias("item_id"), "text").limit(1)
    assert decontam.find_leaks(docs, items, id_col="key id").count() == 6
    assert tokencount.count_tokens(docs, PATH, id_col="key id").first()["key id"]["my id"] >= 0
    labels = odd.select(F.col("key id"), F.lit(1).alias("toxic")).limit(0)
    assert toxicity.classify(docs.withColumn("key id", F.col("doc_id")), labels.withColumn("key id", F.lit(1).cast("long")), id_col="key id").count() == 6


def test_one_row_of_a_component_whatever_the_order(spark):
    rows = [(1, "the same text of some words", i, {"k": i}) for i in range(5)] + [(2, "the same text of some words", 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, m map<string,int>")
    kept = {tuple(map(str, r)) for k in (1, 3, 8) for o in ("n", F.desc("n")) for r in simhash.keep_one(docs.orderBy(o).repartition(k)).collect()}
    assert len(kept) == 1
    twice = docs.unionAll(docs)
    assert {tuple(map(str, r)) for r in simhash.keep_one(twice).collect()} == kept and simhash.keep_one(twice).count() == 1


def test_a_hot_id_does_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(100, 130)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(100, 130)], "doc_id long, quality int")
    sample, n = quality.labelled_sample(docs, labels, "quality", "doc_id", "text", 3, 3, 1000)
    counts = {r["id"]: r["n"] for r in sample.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert n == 31 and counts.pop(7) == quality.TEXTS and set(counts.values()) == {1}


@pytest.mark.parametrize("size", [1, 10, 400, 1000, 5000])
def test_lowest_ids_are_those_of_a_full_sort(spark, size):
    rows = spark.range(4000).withColumn("y", F.lit(1))
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(size).collect()]
    assert sorted(r.id for r in quality.lowest_ids(rows, size).collect()) == sorted(want)


def test_every_character_of_a_long_run_counts():
    one, other = "x1" * 40 + "A" * 30, "x1" * 40 + "b" * 30
    assert quality.shape(one) != quality.shape(other)
    r, f, _ = quality.features(["漢" * 500 + "字", "漢" * 500 + "子"])
    assert set(f[r == 0]) != set(f[r == 1]) and len(set(f[r == 0]) & set(f[r == 1])) > 3
    assert quality.words_of("a " + "b" * 64 + " " + "c" * 65) == ["a", "b" * 64, "c" * 64, "c"]
    assert [quality.shape(w) for w in ("*****", "!?!?!?", "a.....b", "1_2")] == ["****", "!?!?!?", "a....a", "0_0"]


GOOD = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nX-Page-ID: %d\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"


@pytest.mark.parametrize("tail, problem, rid", [
    (b"WARC/1.1\r\nWARC-Type: resp", "archive ends within a header", None),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\n\r\nbody\r\n\r\n", "record without a length", None),
    (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n", "record without a length", None),
    (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -3\r\n\r\n", "record without a length", None),
    (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort", "archive ends within a record", None),
    (b"noise\r\n", "not at the start of a record", None),
    (b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n", "record without an identifier", ""),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nX-Page-ID: seven\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n", "number that is none", "<x>")])
def test_damaged_archives_give_a_row(spark, scratch, tail, problem, rid):
    for name, data in (("a.warc", GOOD % (1, 1) + GOOD % (2, 2) + tail), ("b.warc.gz", gzip.compress(GOOD % (3, 3)))):
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(data)
    rows = warc.read_archives(spark, scratch).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in rows if r.problem is None) == [(i, b"hi") for i in (1, 2, 3)]
    bad = [r for r in rows if r.problem is not None]
    assert [(r.record_type, r.problem, r.payload) for r in bad] == [("damaged", problem, None)]
    assert bad[0].record_id.endswith("/a.warc") if rid is None else (bad[0].record_id or "") == rid


def test_cut_compression_and_large_archives(spark, scratch):
    whole = gzip.compress(os.urandom(10) + (GOOD % (1, 1)) * 50)
    with open(f"{scratch}/a.gz", "wb") as f:
        f.write(gzip.compress(GOOD % (5, 5)) + whole[:len(whole) // 2])
    with open(f"{scratch}/b.warc", "wb") as f:
        f.write((GOOD % (6, 6)) * 40)
    rows = warc.read_archives(spark, scratch, largest=2000).collect()
    assert sorted(r.problem for r in rows if r.problem)[0] == "archive too large"
    assert any(r.problem in ("broken compression", "not at the start of a record") for r in rows)
    assert {r.page_id for r in rows if not r.problem} <= {5}
