"""Re-nesting keeps NULLs and order; shredding then re-nesting gives the input back.

Operators: A5-A9, A15-A17, C1, C2, E1-E3, K1-K4.
"""

from pyspark.sql import functions as F

from cardlake.operators import nest, quality, shred
from cardlake.sources.jsondocs import snake_case


def test_ordered_list_keeps_nulls_and_order(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    child = spark.createDataFrame([(1, 2, "b"), (1, 0, None), (1, 1, "a"), (3, 0, "z")], "pid int, idx int, v string")
    out = nest.renest(parent, child, "id", "pid", ["idx"], ["v"], "vs", scalar=True)
    got = {r.id: r.vs for r in out.collect()}
    assert got == {1: [None, "a", "b"], 2: None, 3: ["z"]}


def test_descend_drops_childless(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    c = spark.createDataFrame([(1, "x")], "pid int, v string")
    assert [r.id for r in nest.descend(p, c, "id", "pid").collect()] == [1]


def test_shred_round_trip(spark):
    schema = "k string, a struct<b string, c int>, xs array<struct<n string, ys array<string>>>, tags array<string>"
    data = [("r1", ("x", 1), [("n1", ["p", None]), ("n2", [])], ["t1", "t2"]), ("r2", None, None, [])]
    df = spark.createDataFrame(data, schema)
    t = shred.shred(df, "doc", ["k"])
    assert set(t) == {"doc", "doc__xs", "doc__xs__ys", "doc__tags"}
    assert set(t["doc"].columns) == {"k", "a__b", "a__c", "_id"}
    ys = nest.nest_children(t["doc__xs__ys"], "_parent_id", ["_idx"], ["value"], "ys", scalar=True)
    xs = t["doc__xs"].join(ys, t["doc__xs"]["_id"] == ys["_parent_key"], "left")
    xs_agg = nest.nest_children(xs, "_parent_id", ["_idx"], ["n", "ys"], "xs")
    back = t["doc"].join(xs_agg, t["doc"]["_id"] == xs_agg["_parent_key"], "left")
    got = {r.k: [(x.n, x.ys) for x in r.xs] if r.xs is not None else None for r in back.collect()}
    assert got == {"r1": [("n1", ["p", None]), ("n2", None)], "r2": None}
    # keys are stable across runs
    again = shred.shred(df, "doc", ["k"])["doc__xs"].select("_id").collect()
    assert sorted(r._id for r in again) == sorted(r._id for r in t["doc__xs"].select("_id").collect())


def test_flatten_and_snake_case(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "id int, a struct<b int, c struct<d int>>")
    assert shred.flatten(df).columns == ["id", "a__b", "a__c__d"]
    assert snake_case("filière") == "fili_re"
    assert snake_case("spécialité") == "sp_cialitx"
    assert snake_case("8H30 / 10H") == "_8_h30_10_h"


def test_map_to_wide_drops_unknown_keys(spark):
    df = spark.createDataFrame([("s", {"LU": {"8H": [1, 2]}, "DI": {"8H": [3]}})], "s string, m map<string,map<string,array<int>>>")
    out = shred.map_to_wide(df, "m", {"LU": "lu", "MA": "ma"}, {"8H": "h8"}, "e")
    r = out.first()
    assert out.columns == ["s", "e__lu__h8", "e__ma__h8"]
    assert (r.e__lu__h8, r.e__ma__h8) == ("[1,2]", None)


def test_quality_suite(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (2, "b")], "k int, v string")
    res = quality.run_suite({"t": df}, [quality.Spec("t", "k", ("not_null", "unique")), quality.Spec("t", "v", ("not_null", "unique"))])
    got = {(r.column_name, r.test): (r.failures, r.status) for r in res.collect()}
    assert got == {("k", "not_null"): (1, "fail"), ("k", "unique"): (1, "fail"),
                   ("v", "not_null"): (1, "fail"), ("v", "unique"): (1, "fail")}


def test_schema_check(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    res = {(r.table_name, r.column_name): (r.failures, r.status)
           for r in quality.schema_check(spark, "t", df, ["id", "name", "missing"]).collect()}
    assert res == {("t", "id"): (0, "pass"), ("t", "name"): (0, "pass"), ("t", "missing"): (1, "fail")}
    absent = quality.schema_check(spark, "gone", None, ["id"]).collect()
    assert [(r.failures, r.status) for r in absent] == [(1, "fail")]
