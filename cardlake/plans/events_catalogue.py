"""Query catalogue, part 3: answer-event frames, producer events, context capture, vector
normalisation, identifier normalisation, the load report, nested JSON composition and
JSON document unwrapping on the driver tables (SURVEY section 7).  SQL twins in :mod:`cardlake.plans.oracle_events`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.jsonx import compose_object, parse_strict, to_json_text
from cardlake.functions.vectors import dot, l2_normalize
from cardlake.operators import nest, shred
from cardlake.plans import catalogue
from cardlake.session import cut, table
from cardlake.sources import frames, jsondocs
from cardlake.streaming import fold


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as the answer events of message ``conv_id``."""
    c = table(spark, sf, "conversations")
    t = F.when(F.col("role") == "assistant", "delta").when(F.col("role") == "system", "done").otherwise("prompt")
    return c.select(F.col("conv_id").alias("msg_id"), F.col("turn").alias("seq"), t.alias("type"), "text")


def encode_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one ``data: {json}`` frame."""
    enc = frames.encode_frames(_events(spark, sf), ("type", "text"), keep=("msg_id", "seq"))
    return enc.withColumnRenamed("value", "frame")


def decode_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame read back into its event.  Beside it comes a copy cut short (the closing
    brace lost, as the end of a broken stream leaves it), which fails to parse and is
    dropped, as the client drops it (A24)."""
    enc = frames.encode_frames(_events(spark, sf), ("msg_id", "seq", "type", "text"))
    return frames.parse_frames(enc.unionAll(enc.select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))))


# Fixed value: error text sent when a message produced no answer chunk.
NO_ANSWER = "Aucune réponse n'a été générée."


def answer_events(spark: SparkSession, sf: str) -> DataFrame:
    """Producer side (L2, E12): assistant turns are the streamed chunks, each sent as a
    ``delta``; then one ``done`` carrying the whole answer, or one ``error`` when the
    message produced no chunk at all."""
    c = table(spark, sf, "conversations")
    chunks = c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("msg_id"), F.col("turn").alias("seq"),
                                                          "text")
    assistant = F.col("role") == "assistant"
    finals = c.groupBy(F.col("conv_id").alias("msg_id")).agg(
        F.array_join(nest.ordered_list(["turn"], ["text"], scalar=True, keep=assistant), "").alias("final_text"),
        F.when(F.count_if(F.col("role") == "assistant") == 0, F.lit(NO_ANSWER)).alias("error"))
    return fold.answer_events(chunks, finals)


def first_context(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed chunk stream: user turns carry the context, the others carry answer text;
    the context of each message is the first one by ``seq`` (L3)."""
    c = table(spark, sf, "conversations")
    chunks = c.select(F.col("conv_id").alias("msg_id"), F.col("turn").alias("seq"),
                      F.when(F.col("role") == "user", F.col("text")).alias("context"))
    return fold.first_context(chunks)


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding scaled to unit length (H23): norm before and after, largest
    component and its 1-based position."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", l2_normalize("embedding").alias("unit"))
    top = F.array_max("unit")
    return e.select(
        "vec_id",
        F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm_in"),
        F.round(F.sqrt(dot("unit", "unit")), 6).alias("norm_out"),
        F.round(top.cast("double"), 6).alias("max_component"),
        F.array_position("unit", top).cast("bigint").alias("max_position"),
    )


def snake_case_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Source names normalised to snake_case identifiers (A9): part names and types,
    supplier and nation names, document sources."""
    parts = [
        table(spark, sf, "part").select(F.lit("p_name").alias("source"), F.col("p_partkey").alias("id"),
                                        F.col("p_name").alias("raw")),
        table(spark, sf, "part").select(F.lit("p_type").alias("source"), F.col("p_partkey").alias("id"),
                                        F.col("p_type").alias("raw")),
        table(spark, sf, "supplier").select(F.lit("s_name").alias("source"), F.col("s_suppkey").alias("id"),
                                            F.col("s_name").alias("raw")),
        table(spark, sf, "nation").select(F.lit("n_name").alias("source"), F.col("n_nationkey").alias("id"),
                                          F.col("n_name").alias("raw")),
        table(spark, sf, "documents").select(F.lit("source").alias("source"), F.col("doc_id").alias("id"),
                                             F.col("source").alias("raw")),
    ]
    u = reduce(DataFrame.unionByName, parts)
    return u.select("source", F.col("id").cast("bigint").alias("id"), "raw", shred.snake_case_col("raw").alias("key"))


def load_report(spark: SparkSession, sf: str) -> DataFrame:
    """Customers re-nested with orders and items, shredded into the three keyed tables a
    load would write, and the row count of each (A6, A11, A13).  The nested root is cut
    once, as a load does before writing its child tables."""
    ords = catalogue._orders_with_items(spark, sf)
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "items"]
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    # the nested root is materialised once; every child table is then a narrow explode of it
    nested = cut(nest.renest(c, ords, "c_custkey", "o_custkey", ["o_orderkey"], fields, "orders"))
    tables = shred.shred(nested, "customers", ["c_custkey"])
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# Display names of the planning object, days then event types, in order.
PLAN_DAYS = {"lu": "Lundi", "ma": "Mardi", "me": "Mercredi", "je": "Jeudi", "ve": "Vendredi", "sa": "Samedi"}
PLAN_TYPES = {"click": "clic", "view": "vue", "purchase": "achat", "signup": "inscription"}


def compose_planning(spark: SparkSession, sf: str) -> DataFrame:
    """The wide per-user cells of ``map_lookup_wide`` composed back into one nested JSON
    object day -> type -> event ids, each cell parsed strictly (H17, H18)."""
    wide = catalogue.map_lookup_wide(spark, sf)
    layout = [(day, [(name, parse_strict(f"plan__{dc}__{tc}")) for tc, name in PLAN_TYPES.items()])
              for dc, day in PLAN_DAYS.items()]
    return wide.select("user_id", to_json_text(compose_object(layout)).alias("planning_json"))


CLIENT_DOC = ("client struct<c_custkey: bigint, c_name: string, commandes: array<struct<o_orderkey: bigint, "
              "o_orderstatus: string, o_orderdate: string>>>")


def json_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer written as one JSON document ``{"client": {..., "commandes": [...]}}``,
    decoded with a declared schema (A1), the envelope unwrapped to columns (A3) and the
    order list unwrapped to one row per element (A4)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus",
                                          F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    nested = nest.renest(c, o, "c_custkey", "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"],
                         "commandes")
    docs = nested.select(F.to_json(F.struct(F.struct("c_custkey", "c_name", "commandes").alias("client")))
                         .alias("doc"))
    client = shred.unwrap(jsondocs.decode_documents(docs, "doc", CLIENT_DOC), "client")
    return shred.unwrap_list(client, "commandes", ["c_custkey", "c_name"])


QUERIES = {
    "encode_frames": encode_frames,
    "decode_frames": decode_frames,
    "answer_events": answer_events,
    "first_context": first_context,
    "vector_normalize": vector_normalize,
    "snake_case_keys": snake_case_keys,
    "load_report": load_report,
    "compose_planning": compose_planning,
    "json_unwrap": json_unwrap,
}
