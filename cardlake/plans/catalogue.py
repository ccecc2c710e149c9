"""Query catalogue on the driver tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame built from the given
tables; its twin SQL lives in :mod:`cardlake.plans.oracle` under the same key.  Nested
results are emitted as JSON text holding only integers and strings, doubles that come
out of arithmetic are rounded, and every computed column is aliased, so both engines
print the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.jsonx import decode_twice, parse_lenient, parse_strict, to_json_text
from cardlake.functions.names import format_title, normalize_name, parse_list_text, strip_quotes
from cardlake.functions.text import extract_emails
from cardlake.operators import lookup, nest, quality, retrieve, shred, stats
from cardlake.session import table

Query = Callable[[SparkSession, str], DataFrame]

ITEM_FIELDS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("l_quantity"), "l_returnflag", "l_linestatus",
    )
    return nest.nest_children(li, "l_orderkey", ITEM_FIELDS, ITEM_FIELDS, "items")


def _orders_with_items(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )
    items = _items(spark, sf)
    return o.join(items, o.o_orderkey == items._parent_key, "left").drop("_parent_key")


def renest_two_level(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their orders, each order with its line items."""
    ords = _orders_with_items(spark, sf)
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "items"]
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    nested = nest.renest(c, ords, "c_custkey", "o_custkey", ["o_orderkey"], fields, "orders")
    return nested.select(
        "c_custkey", "c_name", F.size("orders").cast("bigint").alias("n_orders"),
        to_json_text("orders").alias("orders_json"),
    )


def hierarchy_inner(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation -> customer, INNER joins down the hierarchy."""
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer")
    return nest.descend(nest.descend(r, n, "r_regionkey", "n_regionkey"), c, "n_nationkey", "c_nationkey").select(
        "r_name", "n_name", "c_custkey", "c_name"
    )


def childless_parent_null(spark: SparkSession, sf: str) -> DataFrame:
    """Orders LEFT JOIN their line numbers: no line items -> NULL, not []."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    out = nest.renest(o, li, "o_orderkey", "l_orderkey", ["l_linenumber"], ["l_linenumber"], "lines", scalar=True)
    return out.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("lines").isNotNull(), F.size("lines")).cast("bigint").alias("n_items"),
        to_json_text("lines").alias("linenumbers_json"),
    )


def shred_children(spark: SparkSession, sf: str) -> DataFrame:
    """Orders re-nested with their items, shredded back to a keyed child table."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("l_quantity")
    )
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    o = table(spark, sf, "orders").select("o_orderkey")
    nested = nest.renest(o, li, "o_orderkey", "l_orderkey", fields, fields, "items")
    return shred.shred(nested, "orders", ["o_orderkey"])["orders__items"]


def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    """Nested customer struct flattened to ``a__b__c`` columns."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    nested = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey).select(
        "c_custkey",
        F.struct(
            "c_name", "c_mktsegment",
            F.struct("n_name", F.struct("r_name").alias("region")).alias("nation"),
        ).alias("customer"),
    )
    return shred.flatten(nested)


# Weekday and event-type codes of the wide layout; other keys are dropped.
DAY_CODES = {"Mon": "lu", "Tue": "ma", "Wed": "me", "Thu": "je", "Fri": "ve", "Sat": "sa"}
TYPE_CODES = {"click": "click", "view": "view", "purchase": "purchase", "signup": "signup"}


def map_lookup_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Per user a map weekday -> event type -> event ids, projected to fixed wide JSON
    columns; unmapped days/types dropped (A15-A17)."""
    ev = table(spark, sf, "events").select(
        "user_id", F.date_format("ts", "EEE").alias("day"), "event_type", "event_id"
    )
    cells = ev.groupBy("user_id", "day", "event_type").agg(
        nest.ordered_list(["event_id"], ["event_id"], scalar=True).alias("ids")
    )
    days = cells.groupBy("user_id", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "ids"))).alias("slots")
    )
    plan = days.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "slots"))).alias("plan"))
    return shred.map_to_wide(plan, "plan", DAY_CODES, TYPE_CODES, "plan")


def json_strict_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """``events.props`` decoded strictly, leniently, and from a double-encoded copy."""
    ev = table(spark, sf, "events").select("event_id", "props")
    quoted = F.concat(F.lit('"'), F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                      F.lit('"'))
    return ev.select(
        "event_id",
        F.variant_get(parse_strict("props"), "$.k", "bigint").alias("k_strict"),
        F.try_variant_get(parse_lenient("props"), "$.k", "bigint").alias("k_lenient"),
        decode_twice(quoted, "k bigint")["k"].alias("k_double"),
    )


def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix exclusion plus present-and-not-containing filter."""
    p = table(spark, sf, "part")
    return p.where(
        ~F.col("p_name").startswith("small")
        & (F.coalesce(F.col("p_type"), F.lit("")) != "")
        & ~F.col("p_type").contains("PROMO")
    ).select("p_partkey", "p_name", "p_type")


# Fixed value: column tests run over the driver tables.
QUALITY_SPECS = [
    quality.Spec("region", "r_regionkey", ("not_null", "unique")),
    quality.Spec("region", "r_name", ("not_null",)),
    quality.Spec("nation", "n_nationkey", ("not_null", "unique")),
    quality.Spec("customer", "c_custkey", ("not_null", "unique")),
    quality.Spec("customer", "c_name", ("not_null",)),
    quality.Spec("supplier", "s_suppkey", ("not_null", "unique")),
    quality.Spec("part", "p_partkey", ("not_null", "unique")),
    quality.Spec("orders", "o_orderkey", ("not_null", "unique")),
    quality.Spec("orders", "o_custkey", ("not_null",)),
    quality.Spec("lineitem", "l_orderkey", ("not_null", "unique")),
    quality.Spec("lineitem", "l_linenumber", ("not_null",)),
    quality.Spec("events", "event_id", ("not_null", "unique")),
    quality.Spec("documents", "doc_id", ("not_null", "unique")),
    quality.Spec("documents", "text", ("not_null",)),
    quality.Spec("embeddings", "vec_id", ("not_null", "unique")),
    quality.Spec("pages", "page_id", ("not_null", "unique")),
    quality.Spec("benchmark", "item_id", ("not_null", "unique")),
    quality.Spec("labels", "doc_id", ("not_null", "unique")),
    quality.Spec("conversations", "conv_id", ("not_null",)),
    quality.Spec("conversations", "turn", ("not_null",)),
]


def quality_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Not-null and unique tests over the keys of all tables (K1-K3)."""
    names = dict.fromkeys(s.table for s in QUALITY_SPECS)
    tables = {n: table(spark, sf, n) for n in names}
    return quality.run_suite(tables, QUALITY_SPECS)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.lit("part").alias("source"), F.col("p_partkey").cast("string").alias("id"),
                                       F.col("p_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"),
                                           F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("source"),
                                           F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    t = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("source"), F.concat_ws("/", "conv_id", "turn").alias("id"),
        F.col("text").alias("name"))
    return p.unionByName(s).unionByName(c).unionByName(t)


def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    """Name match keys for part, supplier, customer names and whole conversation
    texts (H1, F2)."""
    return _names(spark, sf).select("source", "id", normalize_name("name").alias("name_key"))


def _titled_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    forms = F.array(
        F.col("s_name"), F.concat(F.lit("Dr. "), "s_name"), F.concat(F.lit("pr "), F.lower("s_name")),
        F.concat(F.lit("  Professeure "), "s_name", F.lit(" ")), F.concat(F.lit("'"), "s_name", F.lit("'")), F.lit("Dr."))
    return s.select("s_suppkey", F.explode(forms).alias("raw"))


def format_title_q(spark: SparkSession, sf: str) -> DataFrame:
    """Display names with one normalised title; stray quotes removed (H2, H3): every
    supplier's name as it is, titled in several ways, quoted, and a bare title."""
    s = _titled_suppliers(spark, sf)
    return s.select("s_suppkey", "raw", format_title("raw").alias("display"), strip_quotes("raw").alias("unquoted"))


def parse_list_text_q(spark: SparkSession, sf: str) -> DataFrame:
    """``[a, b]`` list text parsed back into items (H5, H8): every part's whole list and,
    beside it, a list of one item, an empty one and a missing one."""
    p = table(spark, sf, "part")
    raw = F.array(F.concat(F.lit("["), "p_brand", F.lit(", "), "p_type", F.lit(", , "), "p_name", F.lit("]")),
                  F.concat(F.lit("[ "), "p_brand", F.lit(" ]")), F.lit("[]"), F.lit(None).cast("string"))
    items = parse_list_text(F.col("raw"))
    return p.select("p_partkey", F.explode(raw).alias("raw")).select("p_partkey", "raw", F.size(items).cast("bigint").alias("n_items"),
                    to_json_text(items).alias("items_json"))


def _order_pick(spark: SparkSession, sf: str, last: bool) -> DataFrame:
    o = table(spark, sf, "orders")
    return lookup.pick_one(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"],
                           last=last)


def lookup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest order per customer (dictionary ``setdefault``, E6)."""
    return _order_pick(spark, sf, last=False)


def lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Latest order per customer (dictionary assignment, E6)."""
    return _order_pick(spark, sf, last=True)


def entity_join(spark: SparkSession, sf: str) -> DataFrame:
    """Orders name their customer in another format (title, reversed words, upper
    case); resolved on the normalised name against a last-wins lookup (C3-C5)."""
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("Dr. "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" CUSTOMER")).alias("coord"),
    )
    probe = o.select("o_orderkey", format_title("coord").alias("coordinator"), normalize_name("coord").alias("name_key"))
    c = table(spark, sf, "customer").select(normalize_name("c_name").alias("name_key"), "c_custkey", "c_mktsegment")
    people = lookup.pick_one(c, "name_key", ["c_custkey"], ["c_custkey", "c_mktsegment"], last=True)
    return lookup.join_lookup(probe, "name_key", people.withColumnRenamed("name_key", "_key"), "_key").select(
        "o_orderkey", "coordinator", "name_key", "c_custkey", "c_mktsegment")


def rollup_text(spark: SparkSession, sf: str) -> DataFrame:
    """Line items of each order as ordered text lines."""
    li = table(spark, sf, "lineitem")
    line = F.concat(F.lit("- "), F.col("l_linenumber").cast("string"), F.lit(" : part "),
                    F.col("l_partkey").cast("string"), F.lit(" x "), F.col("l_quantity").cast("bigint").cast("string"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return lookup.rollup_text(li.withColumn("line", line), F.col("l_orderkey").alias("l_orderkey"), order, "line",
                              out="lines")


def extract_emails_q(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct e-mails of every whole document."""
    d = table(spark, sf, "documents").select("doc_id", extract_emails("text").alias("emails"))
    return d.select("doc_id", F.size("emails").cast("bigint").alias("n_emails"), to_json_text("emails").alias("emails_json"))


def reject_blank(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with NULL, empty or blank text are rejected (B8).  Every turn comes as it
    is and, beside it, once more as a blank of one of the three forms, by its role."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    blank = F.when(F.col("role") == "user", F.lit("   ")).when(F.col("role") == "assistant", F.lit(""))
    both = c.unionAll(c.withColumn("text", blank))
    asked, rejected = retrieve.split_blank(both, "text")
    return asked.select("conv_id", "turn", F.lit("valid").alias("status")).unionAll(
        rejected.select("conv_id", "turn", F.lit("rejected").alias("status")))


def latency_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, median, min and max of ``value`` per event type, rounded to 2."""
    ev = table(spark, sf, "events").select("event_type", "value")
    basic = ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 2).alias("mean_value"),
        F.round(F.min("value"), 2).alias("min_value"),
        F.round(F.max("value"), 2).alias("max_value"),
    )
    # exact median with bounded memory per group (a plain median buffers a whole group)
    med = stats.exact_quantile(ev, ["event_type"], "value", 0.5, "median_value")
    return basic.join(med, "event_type", "left").select(
        "event_type", "n", "mean_value", F.round("median_value", 2).alias("median_value"), "min_value", "max_value")


QUERIES: dict[str, Query] = {
    "renest_two_level": renest_two_level,
    "hierarchy_inner": hierarchy_inner,
    "childless_parent_null": childless_parent_null,
    "shred_children": shred_children,
    "flatten_struct": flatten_struct,
    "map_lookup_wide": map_lookup_wide,
    "json_strict_lenient": json_strict_lenient,
    "prefix_filter": prefix_filter,
    "quality_suite": quality_suite,
    "normalize_names": normalize_names,
    "format_title": format_title_q,
    "parse_list_text": parse_list_text_q,
    "lookup_first_wins": lookup_first_wins,
    "lookup_last_wins": lookup_last_wins,
    "entity_join": entity_join,
    "rollup_text": rollup_text,
    "extract_emails": extract_emails_q,
    "reject_blank": reject_blank,
    "latency_by_category": latency_by_category,
}
