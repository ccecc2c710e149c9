"""Personal data against a plain restatement: patterns by Python's re, votes and scores
by hand, from the counts that restatement gives."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardlake.llm import pii, queries
from cardlake.session import table

RAW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d),
            "phone": m.startswith("+") and 9 <= len(d) <= 15}[kind]


def base(text):
    return sorted(((m.start(), pii.KINDS.index(k), m.end()) for k, p in RAW.items() for m in re.finditer(p, text or "") if ok(k, m.group())))


def touch(c, first):
    return "open" if not c or c[0 if first else -1] in " \t\n\x0b\f\r" else "word" if re.match(r"\w", c[0 if first else -1]) else "sign"


def votes(kind, m, left, right, is_base):
    has = lambda p, s: bool(re.search(p, s, re.A))
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        first = [1 if is_base else 0 if has(r"[(\[](?:at|dot)[)\]]", m.lower()) else -1,
                 int(has(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$|[(\[]dot[)\]] ?[A-Za-z]{2,}$", m)), 1 if has(rf"(?:\.|[)\]] ?)(?:{pii.TLD})$", m.lower()) else -1]
    elif kind == "ip":
        first = [1 if ok(kind, m) else -1, int(not has(r"(?:^|\.)0[0-9]", m)), -1 if has(pii.NO_HOST, m) else 1]
    elif kind == "card":
        first = [1 if ok(kind, m) else -1, int(has("^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{5}$", m)), 1 if has(pii.ISSUERS, d) else -1]
    else:
        plus = m.startswith("+")
        first = [1 if ok(kind, m) else -1 if plus else 0, int(has(r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$", m)),
                 0 if not plus else 1 if has(f"^(?:{pii.CALLING})", d) else -1]
    a, b = touch(left, False), touch(right, True)
    return (*first, int(has(pii.CUES[kind], left.lower())), -int(has(pii.COUNTER, left.lower())), -1 if "word" in (a, b) else 1), a, b


def spans(text):
    """(start, kind, end, base, votes, left, right) of all base spans and free proposals."""
    out, text = [], text or ""
    taken = base(text)
    for is_base, patterns in ((True, RAW), (False, pii.WIDE)):
        for kind, p in patterns.items():
            found = [m for m in re.finditer(p, text)]
            for i, m in enumerate(found):
                if is_base and not ok(kind, m.group()):
                    continue
                if not is_base and any(a < m.end() and m.start() < b for a, _, b in taken):
                    continue
                left = text[found[i - 1].end() if i else 0:m.start()][-pii.BEFORE:]
                right = text[m.end():found[i + 1].start() if i + 1 < len(found) else len(text)][:pii.AFTER]
                out.append((m.start(), pii.KINDS.index(kind), m.end(), is_base, *votes(kind, m.group(), left, right, is_base)))
    return sorted(out)


def brute(texts):
    found = [spans(t) for t in texts]
    cells = Counter((s[1], s[4], s[5], s[6]) for f in found for s in f)
    w = pii.train(sorted((*c, n) for c, n in cells.items()))
    limit = np.log(pii.SURE / (1 - pii.SURE))
    return [[s[:4] for s in f if s[3] or sum(w.get(x, 0) for x in pii.feature_names(s[1], *s[4:])) >= limit] for f in found]


def text_of(found):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def row(found):
    own = [s[:3] for s in found if s[3]]
    return (*(sum(k == s[1] for s in own) for k in range(4)), hashlib.sha256(text_of(own).encode()).hexdigest(), text_of([s[:3] for s in found]))


ODD = [None, "", "none", "a@b.c_d@e.f", "a@b@c.d x@y z@w.q.r..s", "1.2.3.4.5.6.7.8.9 0001.02.3.255 1.2.3.256 1.2.3", "+1 (826) 555-4081 190.137.223.204",
       "4111111111111111 4111111111111112", "tel (212) 555-1234 or 212-555-1234, +49 170 1234567", "joe (at) site (dot) com joe[at]x.org me@host",
       "é\U0001f600 mail: x@é.com ü@x.com 4111-1111-1111-1111é", "+1((((((((((2", "++1 2 3 4 5 6 7 8 9-", "12 " * 30, "9" * 5000, "1.1" * 4000, "a" * 20_000 + "@", "a@b" + ".c" * 5000,
       "card 3782 822463 10005; visa 5500-0000-0000-0004.", "v1.2.3.4 token=\"4111111111111111\"", "1.2.3.4 " * 700, "x@y.zz " * 600 + "+1 (826) 555-4081 1.1.1.1"]


def test_odd_texts_match_brute_force(spark):
    r = random.Random(5)
    alphabet = ["1", "23", "4111111111111111", ".", ".", "-", " ", "+", "(", ")", "@", "a", "x.y", "255", "é", "\n", "(at)", "555-4081", " tel ", "é\U0001f600"]
    texts = ODD + ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i % 300 or None, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans int, kind string").repartition(4)
    got = pii.find_personal_data(docs).collect()
    want = [(i % 300 or None, [(a, b, pii.KINDS[k], own) for a, k, b, own in f]) for i, f in enumerate(brute(texts))]
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == sorted(want, key=str)
    assert any(not s[3] for _, f in want for s in f)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").collect()
    want = sorted((r.doc_id, *row(f)) for r, f in zip(docs, brute([r.text for r in docs]), strict=True))
    got = queries.QUERIES["op12_pii"](spark, sf)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect())) == want


def test_no_python_in_the_plan(spark):
    df = queries.QUERIES["op12_pii"](spark, "/root/testdata/sf0.001")
    for plan in (df, pii.find_spans(table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text"))):
        plan.write.format("noop").mode("overwrite").save()
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not any(k in text for k in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_spans_inside_a_failed_run_are_added(spark):
    """A phone number and an address that the base pattern runs together, and a card number
    beside another number; a number that fails its check is not added."""
    r = random.Random(2)
    wrong = [d for d in ("".join(r.choices("0123456789", k=16)) for _ in range(200)) if not luhn(d)]
    good = [f"call me +1 (826) 555-{i:04d} today. mail joe{i}@site.com from 190.137.22.{i % 250} {w} 4111111111111111 ok {w} {wrong[i]} no"
            for i in range(60) for w in ["card" if i % 3 else "with"]]
    text = "so +1 (826) 555-4081 190.137.223.204 and 4111111111111111 5500000000000004 and 4111111111111113 9500000000000001"
    docs = spark.createDataFrame([*enumerate(good), (100, text)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, text[s.start:s.end], s.base) for s in r.spans] for r in pii.find_personal_data(docs).where("doc_id = 100").collect()}[100]
    assert got == [("phone", "+1 (826) 555-4081", False), ("ip", "190.137.223.204", True), ("card", "4111111111111111", False), ("card", "5500000000000004", False)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(docs).count() == 0
    none = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert [r.spans for r in pii.find_personal_data(none).collect()] == [[], []]


def test_estimation_finds_the_labelers_reliability():
    rng = np.random.default_rng(0)
    true = rng.random(20_000) < 0.6
    counts = Counter()
    for y in true:
        strict = rng.choice([1, -1], p=[0.95, 0.05] if y else [0.1, 0.9])
        counts[int(strict), int(rng.random() < (0.8 if y else 0.3)), int(rng.choice([1, 0, -1])), int(rng.random() < (0.5 if y else 0.02)), 0, 1] += 1
    chance = pii.estimate(dict(counts))
    got = sum(n * chance[v] for v, n in counts.items()) / sum(counts.values())
    assert got == pytest.approx(0.6, abs=0.06)
    assert chance[1, 1, 0, 1, 0, 1] > 0.99 and chance[-1, 0, 0, 0, 0, 1] < 0.05


def test_running_fold_of_long_arrays(spark):
    rows = [(list(range(n)),) for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame(rows, "a array<int>").select("a", pii.running(F.col("a"), lambda s, x: s + x, F.lit(0)).alias("s"))
    assert all(r.s == np.cumsum(r.a).tolist() for r in df.collect())
