import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cardlake.llm import bpe, quality, queries
from cardlake.session import table
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_native import brute_lines
from tests.llm.test_simhash import brute_components, brute_fingerprint


SF_SMALL = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    labels = table(spark, SF_SMALL, "labels")
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    rows = sorted((r for r in docs.collect() if scores[r.doc_id] >= 0.5), key=lambda r: r.doc_id)
    assert len(rows) < docs.count()
    want = [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, brute_lines([(r.source, r.text) for r in rows], 0.02, 3))]
    fps = [brute_fingerprint(t) for _, t, *_ in want]
    comp = brute_components([i for i, *_ in want], fps)
    want = [w for w, c in zip(want, comp) if w[0] == c]
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    leaked = {i for i, _ in brute_leaks([t for _, t, *_ in want], items)}
    want = [w for i, w in enumerate(want) if i not in leaked]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == [*columns, "token_ids", "n_tokens"]
    got = sorted(got.collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[:5] for r in got] == want
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = table(spark, SF_SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), SF_SMALL)
        assert out.count() == 0
        assert name == "encode" or (out.columns == docs.columns and out.dtypes == docs.dtypes)


def test_stages_take_nulls(spark):
    docs = table(spark, SF_SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f", None, "src0", 1), (10**9, None, "en", "src0", None),
                                 (10**9 + 1, "", "en", None, 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.unionAll(odd), SF_SMALL).collect()
        if name in ("line_dedup", "decontaminate", "encode"):
            assert sum(r.doc_id is None for r in out) == 2, name


def near_copies(spark, docs):
    """A source of 400 pages, 12 of them near copies, and one small source with 3 near copies
    of another text; 20 pages of the first have a line in common.  (rows, ids of each family)"""
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8))) for _ in range(n))
    rows, own = [], {"big": [], "small": []}
    for source, total, near in (("big", 400, 12), ("small", 10, 3)):
        base = [line(30) for _ in range(60)]
        for i in range(total):
            if i % 10 == 7 and len(own[source]) < near or i >= total - near + len(own[source]):
                own[source].append(len(rows))
                text = list(base)
                text[r.randrange(60)] += " edit" + str(i)
            else:
                text = [line(8) for _ in range(5)] + (["Share this page"] if source == "big" and i % 20 == 3 else [])
            rows.append((len(rows), "\n".join(text), "en", source, 0))
    return spark.createDataFrame(rows, docs.schema), rows, own


def test_a_full_representative_of_near_copies_survives(spark):
    docs, rows, own = near_copies(spark, table(spark, SF_SMALL, "documents"))
    assert len(own["big"]) == 12 and len(own["small"]) == 3
    cleaned = corpus_pipeline.line_dedup(spark, docs, SF_SMALL)
    text = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(text[i] == t.replace("\nShare this page", "") for i, t, *_ in rows)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, cleaned, SF_SMALL).collect()}
    for family in own.values():
        assert [i for i in family if i in kept] == family[:1] and kept[family[0]] == rows[family[0]][1]
    assert len(kept) == len(rows) - 11 - 2


def test_encode_notices_what_does_not_decode_back(spark, monkeypatch):
    docs = table(spark, SF_SMALL, "documents").limit(3)
    real = bpe.encode_decode
    spoiled = F.when(F.col("doc_id") == docs.first().doc_id, "x").otherwise(F.col("decoded_text"))
    monkeypatch.setattr(bpe, "encode_decode", lambda *a, **k: real(*a, **k).withColumn("decoded_text", spoiled))
    with pytest.raises(Exception, match="do not decode back"):
        corpus_pipeline.encode(spark, docs, SF_SMALL).collect()


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.SQL) <= set(E.oracle_sql())
