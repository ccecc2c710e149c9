"""Frame reassembly, the index brought up to date, the staged load, the resumed evaluation
and the source declaration over data."""

import random
from collections import Counter
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardlake.operators import evaluate, index, quality
from cardlake.sources import reassembly, staged


def cut_at_random(data, r, most):
    out, at = [], 0
    while at < len(data):
        k = r.randint(1, most)
        out.append(data[at:at + k])
        at += k
    return out


def brute_frames(data):
    """Non-empty frames between runs of at least two line feeds, by number."""
    parts = re.split(rb"\n{2,}", data)
    # a cut never adds a number: a leading blank line is one too
    return [p.strip(b"\n").decode("utf-8", "replace") for p in parts if p.strip(b"\n")]


@pytest.mark.parametrize("most, chunk", [(1, 4096), (3, 2), (7, 3), (60, 4096)])
def test_frames_cut_anywhere_come_back(spark, most, chunk):
    r = random.Random(most)
    streams = {}
    for s in range(12):
        frames = ["".join(r.choice(["a", "é", "日", "\U0001f600", "\n", " ", "{", '"']) for _ in range(r.randint(0, 20))).replace("\n\n", "\n") for _ in range(r.randint(0, 15))]
        streams[s] = ("\n" * r.randint(0, 3) + "".join(f.strip("\n") + "\n" * r.randint(2, 4) for f in frames) + r.choice(["", "cut", "\n"])).encode()
    rows = [(s, 3 * n + s, bytes(p)) for s, d in streams.items() for n, p in enumerate(cut_at_random(d, r, most))]
    r.shuffle(rows)
    rows += [(0, 10**6, b""), (0, 10**6 + 1, None)]
    pieces = spark.createDataFrame(rows, "stream int, n int, data binary").repartition(5)
    got = {}
    for x in reassembly.reassemble(pieces, chunk=chunk).orderBy("stream", "frame").collect():
        got.setdefault(x.stream, []).append(x.value)
    assert got == {s: f for s, d in streams.items() if (f := brute_frames(d))}
    assert reassembly.reassemble(pieces.where("false")).count() == 0


def test_a_hot_stream_is_numbered_in_chunks(spark):
    """One stream with nearly all pieces: no window holds more of them than a chunk."""
    data = "".join(f"frame {i}é\n\n" for i in range(4000)).encode()
    pieces = spark.createDataFrame([(1, n, bytes(p)) for n, p in enumerate(cut_at_random(data, random.Random(1), 9))] + [(2, 0, b"x\n\ny")], "stream int, n long, data binary")
    out = reassembly.reassemble(pieces.repartition(8), chunk=64)
    got = [x.value for x in out.where("stream = 1").orderBy("frame").collect()]
    assert got == [f"frame {i}é" for i in range(4000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "chunk" in plan


def cards(spark, rows):
    return spark.createDataFrame(rows, "card_id string, type string, page_content string")


def counting(spark, seen):
    def encode(df):
        seen.append(df.count())
        return df.withColumn("vec", F.array(F.length("page_content").cast("double")))
    return encode


def test_only_new_and_changed_cards_are_encoded(spark, scratch):
    path, seen = f"{scratch}/index", []
    first = [("a", "t", "one"), ("b", "t", "two"), ("c", "u/x", "three"), ("d", "w", "four"), ("a", "t", "one"), (None, "t", "x"), ("e", None, "y")]
    second = [("a", "t", "one"), ("b", "t", "two!"), ("c", "u/x", "three"), ("n", "new", "five"), ("z", "t", None)]
    index.update_index(cards(spark, first), path, counting(spark, seen))
    before = staged.read_manifest(spark, path)[1]
    report = {r.type: tuple(r)[1:] for r in index.update_index(cards(spark, second), path, counting(spark, seen)).collect()}
    assert seen == [4, 3]
    assert report == {"t": (1, 2, 1), "u/x": (1, 0, 0), "w": (0, 0, 1), "new": (0, 1, 0)}
    after = staged.read_manifest(spark, path)[1]
    assert set(after) == {"t", "u/x", "new"} and after["u/x"] == before["u/x"]  # an untouched type's folder stays
    got = sorted((r.card_id, r.type, r.page_content, r.vec) for r in index.read_index(spark, path).collect())
    fresh = f"{scratch}/fresh"
    index.update_index(cards(spark, second), fresh, counting(spark, seen))
    assert got == sorted((r.card_id, r.type, r.page_content, r.vec) for r in index.read_index(spark, fresh).collect())
    index.update_index(cards(spark, second), path, counting(spark, seen))
    assert len(seen) == 3 and staged.read_manifest(spark, path)[0] == 2  # nothing changed: nothing is encoded or written


def test_a_typed_read_opens_its_folder_only(spark, scratch):
    path = f"{scratch}/index"
    index.update_index(cards(spark, [("a", "t", "one"), ("c", "u", "three")]), path, counting(spark, []))
    typed = index.read_index(spark, path, ["u"])
    assert [r.card_id for r in typed.collect()] == ["c"] and all("_type=u" in f for f in typed.inputFiles())
    assert index.read_index(spark, path, ["none"]) is None


def test_a_failed_load_leaves_the_old_tables(spark, scratch):
    old = {f"t{i:02d}": spark.range(i).withColumn("k", F.when(F.col("id") > 1, F.col("id"))) for i in range(16)}
    report = staged.load_staged(spark, old, scratch, {n: ["k"] for n in old})
    assert {r.table_name: (r.rows, r.null_keys) for r in report.collect()} == {f"t{i:02d}": (i, min(i, 2)) for i in range(16)}
    new = {n: df.withColumn("k", F.lit(1)) for n, df in old.items()}
    new["t08"] = new["t08"].withColumn("k", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        staged.load_staged(spark, new, scratch)
    seen = staged.read_staged(spark, scratch)
    assert sorted(seen) == sorted(old) and all(seen[f"t{i:02d}"].count() == i and seen[f"t{i:02d}"].where("k = 1").count() == 0 for i in range(16))
    staged.load_staged(spark, {"only": spark.range(3)}, scratch)
    assert list(staged.read_staged(spark, scratch)) == ["only"]


def test_two_runs_cannot_take_one_manifest(spark, scratch):
    staged.swap_manifest(spark, scratch, 0, {"a": "x"})
    with pytest.raises(RuntimeError, match="another run"):
        staged.swap_manifest(spark, scratch, 0, {"a": "y"})
    assert staged.read_manifest(spark, scratch) == (1, {"a": "x"})


def test_a_rerun_answers_what_is_left(spark, scratch):
    rows = [(f"c{i % 3}", i % 3, i, f"q{i}", f"question {i}" if i != 4 else "bad") for i in range(9)]
    questions = spark.createDataFrame(rows, "category string, category_ord int, pos int, id string, question string")

    def answerer(tag):
        def make():
            def answer(q):
                if q == "bad" and tag != "third":
                    raise ValueError("no")
                return f"{tag}: {q}"
            return answer
        return make

    log = f"{scratch}/log"
    evaluate.resume(questions.where("pos < 5"), answerer("first"), log)
    second = {r.id_question: (r.reponse_ia, r.run) for r in evaluate.resume(questions, answerer("second"), log).collect()}
    assert second == {f"q{i}": (evaluate.FAILED + "no", 1) if i == 4 else (f"{'first' if i < 5 else 'second'}: question {i}", 1 if i < 5 else 2) for i in range(9)}
    third = evaluate.resume(questions, answerer("third"), log, retry_failed=True)
    assert {r.id_question: r.run for r in third.collect()} == {f"q{i}": 3 if i == 4 else 1 if i < 5 else 2 for i in range(9)}
    evaluate.write_results(third, f"{scratch}/out")
    back = evaluate.read_results(spark, f"{scratch}/out").collect()
    assert sorted((r.category, r.nth, r.id_question) for r in back) == sorted((f"c{i % 3}", i // 3, f"q{i}") for i in range(9))


def test_conformance_counts_values_of_the_wrong_type(spark):
    df = spark.createDataFrame([("1", "2020-01-01", "x", "t"), ("x", "2020-13-01", None, "u"), (None, None, "y", "v")], "k string, d string, s string, more string")
    got = {(r.column_name, r.test): (r.failures, r.status) for r in quality.conformance("t", df, StructType.fromDDL("K int, d date, s string, gone double")).collect()}
    assert got == {("K", "type"): (1, "fail"), ("d", "type"): (1, "fail"), ("s", "type"): (0, "pass"), ("gone", "missing"): (3, "fail"), ("more", "extra"): (0, "extra")}


def test_records_that_do_not_parse_are_quarantined(spark, scratch):
    from cardlake.sources import jsondocs

    schema = "name string, n int"
    lines = ['{"name": "a", "n": 1, "_pos": "f:0"}', '{"name": "b"', "noise", '{"name": "c", "n": "many", "_pos": "f:3"}', '{"name": "d", "n": 4}', "",
             '{"name": null, "_pos": "f:6", "more": [1]}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{scratch}/docs")
    good, bad = jsondocs.read_lines(spark, f"{scratch}/docs", schema)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([("a", 1, "f:0"), (None, None, "f:6")], key=str)
    assert sorted(r.record for r in bad.collect()) == sorted([lines[1], lines[2], lines[3], '{"name":"d","n":4}'])
    jsondocs.write_lines(good, f"{scratch}/again")
    assert sorted(map(tuple, jsondocs.read_lines(spark, f"{scratch}/again", schema)[0].collect()), key=str) == sorted(map(tuple, good.collect()), key=str)
    none, broken = jsondocs.read_lines(spark, f"{scratch}/absent", schema)
    assert none.count() == broken.count() == 0 and none.columns == ["name", "n", "_pos"]


@pytest.mark.parametrize("match", ["substring", "word"])
def test_indexed_bank_equals_the_literal_one(spark, match):
    from cardlake.operators import retrieve

    r = random.Random(6)
    words = ["je", "ve", "lab", "é\U0001f600", "contact", "le labo", "a", "ordre du jour", "", "xyz", "jour de", "日本語の"]
    bank = spark.createDataFrame([(f"t{k}", k, i, "".join(r.choices(words + [" "], k=r.randint(1, 3)))) for k in range(5) for i in range(30)] + [("t9", 9, 0, None)],
                                 "type string, type_ord int, kw_ord int, kw string")
    texts = [None, "", "a", "É\U0001f600"] + ["".join(r.choices(words + [" ", "-"], k=r.randint(1, 9))) for _ in range(80)] + ["ordre du jour " * 2000]
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "qid int, question string")
    bank = bank.where("kw is not null")
    want = retrieve.classify(questions, bank, match=match)
    got = retrieve.classify(questions, bank.unionAll(bank.limit(0)), match=match, literal=0)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_measured_bank_moves_no_text(spark):
    """a bank under the broadcast limit is looked up where the texts lie; the joined plan gives the same rows."""
    from cardlake.operators import retrieve

    r = random.Random(7)
    words = ["je", "ve", "lab", "é\U0001f600", "contact", "le labo", "a", "ordre du jour", "xyz", "日本語の", "aaaaaaaaa", "?"]
    bank = spark.createDataFrame(
        [(f"t{k % 4}", [3, 1, 1, None, 2][k], i, "".join(r.choices(words + [" "], k=r.randint(0, 4)))) for k in range(5) for i in range(40)]
        + [("t9", 9, 0, None), ("t9", 9, 1, "contact"), ("t9", 9, 2, "contact")], "type string, type_ord int, kw_ord int, kw string")
    texts = [None, "", "a", "É\U0001f600", "aaaaaaaa", "CONTACT", "nul"] + ["".join(r.choices(words + [" ", "-", "\n"], k=r.randint(1, 9))) for _ in range(80)]
    texts += ["x" * 65530 + "ordre du jour contact" + "y" * 70000, "ordre du jour " * 2000]
    questions = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "qid int, question string")
    for some in (bank, bank.where("kw <> ''"), bank.where("length(kw) > 9")):
        got = retrieve.classify(questions, some, literal=0)
        joined = retrieve.classify(questions, some, literal=0, broadcast_bytes=0)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)
        plain = [((t, o), k) for t, o, k in some.where("kw is not null").select("type", "type_ord", "kw").collect()]
        for _, text, _, score in got.collect():
            assert score == max(Counter(t for t, k in plain if k in (text or "").lower()).values(), default=0)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
