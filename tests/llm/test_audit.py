import itertools
import random
import re

import numpy as np
import pytest

from cardlake.llm import audit
from cardlake.session import table
from tests.conftest import SF_SMALL


def brute(rows, labels):
    """Every order applied document by document; rows are (id, text, part)."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    fails = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append({"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                      "D": bool(re.search(r"[#$%&*|]", t)), "E": copy})
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p for *_, p in rows}:
        own = [k for k, r in enumerate(rows) if r[2] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = set(own)
            for k, f in enumerate(order):
                gone = {x for x in left if fails[x][f]}
                bad = {x for x in own if fails[x][f]}
                left -= gone
                total[f] += len(gone)
                out[part, order, k + 1] = [len(left), len(gone), len(bad) - len(gone), sum(sum(fails[x].values()) == 1 for x in bad),
                                           sum(rows[x][0] in good for x in gone), sum(rows[x][0] in toxic for x in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(total[key[1][key[2] - 1]])
    return out


def check(spark, rows, labels, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n long, key int").repartition(parts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, marks).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == brute(rows, labels)


def test_matches_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "C", "WORD", "x#", "é", "long"]) + str(r.randint(0, m)) for _ in range(n))
             for n in (0, 1, 5, 199, 200, 201, 400) for m in (0, 3, 150)] + [None, "", "  \t", "A\x0bB\x0cC\x85D\xa0E", "#", "x" * 100_000]
    rows = [(i if r.random() < 0.9 else r.choice([None, 3, 5]), r.choice(texts), r.choice(["s", "t", "", None])) for i in range(120)]
    rows += [(7, texts[4], "s")] * 3 + [(None, "same", "t")] * 2 + [(9, "same", "t"), (8, "same", "s"), (8, "same", "s")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    check(spark, rows, labels)


def test_one_text_and_one_id_hold_most_rows(spark):
    rows = [(i, "hot # text", "s" if i % 2 else "t") for i in range(60)] + [(5, f"w{i}", "s") for i in range(40)]
    check(spark, rows, [(0, 1, 0), (5, 1, 1)], parts=7)


def test_walk_equals_counting_each_subset():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (4, audit.STATES, 3))
    states = audit.walk(counts)
    for s in range(audit.STATES):
        assert np.array_equal(states[:, s], counts[:, [m for m in range(audit.STATES) if not m & s]].sum(axis=1))


def test_empty_tables(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    assert audit.audit(docs.where("false"), labels).count() == 0
    got = audit.audit(docs.limit(3), labels.where("false"))
    assert got.schema.simpleString() == f"struct<{audit.SCHEMA.replace(' ', ':').replace(',:', ',')}>"
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() % 600 == 0


@pytest.mark.parametrize("parts", [1, 130])
def test_many_parts(spark, parts):
    rows = [(i, "a b", f"p{i % parts}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels)
    assert got.count() == 600 * parts
    assert got.where("step = 1 and filter_order = 'ABCDE'").groupBy().sum("removed").first()[0] == 200
