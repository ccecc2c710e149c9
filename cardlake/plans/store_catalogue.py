"""Query catalogue, part 5: frames put together from cut pieces, the index brought up to
date, the staged load, the resumed evaluation, the source declaration over data, the streaming
fold and re-nesting in pages, on the driver tables.  SQL twins in :mod:`cardlake.plans.oracle_store`."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from cardlake.functions.jsonx import to_json_text
from cardlake.operators import evaluate, index, paging, quality, retrieve
from cardlake.operators.embed import md5_encoder
from cardlake.plans import cards_catalogue, domain_catalogue, events_catalogue
from cardlake.session import checkpoint_dir, table
from cardlake.sources import frames, jsondocs, reassembly, staged
from cardlake.streaming import keeper


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reassemble_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's frames as one byte stream, cut inside every frame at an odd
    byte and inside every blank line, put together and read back into events (L4, A24)."""
    enc = frames.encode_frames(events_catalogue._events(spark, sf), ("msg_id", "seq", "type", "text"), keep=("msg_id", "seq"))
    data = F.col("value").cast("binary")
    middle = F.octet_length("value").bitwiseOR(F.lit(2)) / 2
    at = middle.cast("int").bitwiseOR(F.lit(1))
    feed = F.lit("\n").cast("binary")
    pieces = enc.select("msg_id", F.inline(F.array(
        F.struct((2 * F.col("seq")).alias("n"), F.concat(feed, F.substring(data, F.lit(1), at)).alias("data")),
        F.struct((2 * F.col("seq") + 1).alias("n"), F.concat(F.substring(data, at + 1, F.octet_length("value")), feed).alias("data")))))
    return frames.parse_frames(reassembly.reassemble(pieces, "msg_id"))


def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """An index of an earlier corpus (nation cards with other texts, no region cards, cards
    since gone) brought up to the whole corpus, and read again (A20, A21, A23, J1)."""
    cards = cards_catalogue.corpus_union(spark, sf).select("card_id", "type", "page_content")
    nation, region = F.col("type") == "nation", F.col("type") == "region"
    earlier = (cards.where(~region).withColumn("page_content", F.when(nation, F.upper("page_content")).otherwise(F.col("page_content")))
               .unionAll(cards.where(region).select(F.concat(F.lit("old:"), "card_id"), F.lit("gone"), "page_content")))
    path = _folder(spark, "index")
    index.update_index(earlier, path, md5_encoder)
    index.update_index(cards, path, md5_encoder)
    got = index.read_index(spark, path)
    return got.select("card_id", "type", "content_hash", F.size(F.filter("vec", lambda x: x != 0)).cast("bigint").alias("n_slots"))


def staged_load(spark: SparkSession, sf: str) -> DataFrame:
    """The 16 relational tables written and made visible together; rows and null keys as
    observed by the writes, and the rows that a reader sees (A10, A12, A13, A20)."""
    tables = domain_catalogue._tables(spark, sf)
    path = _folder(spark, "load")
    report = staged.load_staged(spark, tables, path, {n: [df.columns[0]] for n, df in tables.items()})
    seen = [df.agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(n).alias("table_name"), "rows_read")
            for n, df in staged.read_staged(spark, path).items()]
    return report.join(reduce(DataFrame.unionAll, seen), "table_name")


def _words_counter():
    """Deterministic answerer: the number of characters; fails for questions of under four words."""
    def answer(question: str) -> str:
        if len(question.split(" ")) < 4:
            raise ValueError("trop court")
        return str(len(question))

    return answer


def evaluate_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn asked in two runs over one log: the first answers the users'
    turns, the second what is left; the result as the nested sink gives it back (J9, A19, A22)."""
    c = table(spark, sf, "conversations")
    questions = c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("category"), F.lit(0).alias("category_ord"),
                         F.col("turn").cast("int").alias("pos"), F.col("turn").cast("string").alias("id"), F.col("text").alias("question"), "role")
    path = _folder(spark, "answers")
    evaluate.resume(questions.where("role = 'user'").drop("role"), _words_counter, f"{path}/log")
    results = evaluate.resume(questions.drop("role"), _words_counter, f"{path}/log")
    evaluate.write_results(results, f"{path}/results")
    return evaluate.read_results(spark, f"{path}/results").select("category", "nth", "id_question", "question", "reponse_ia")


def documents_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The six nested documents written as JSON lines, every record once whole and once cut in
    half, and read with their schemas: documents, distinct positions and quarantined records
    of each, and of one that is not there (A1, A2)."""
    root, out = _folder(spark, "documents"), []
    for name, docs in domain_catalogue.documents(spark, sf).items():
        whole = docs.select(F.to_json(F.struct("*")).alias("value"))
        half = whole.select(F.expr("substring(value, 1, length(value) div 2)").alias("value"))
        whole.unionAll(half).write.text(f"{root}/{name}")
        out.append(_scanned(spark, root, name))
    return reduce(DataFrame.unionAll, [*out, _scanned(spark, root, "professeurs.json", "absent.json")])


def _scanned(spark: SparkSession, root: str, name: str, folder: str | None = None) -> DataFrame:
    good, bad = jsondocs.read_lines(spark, f"{root}/{folder or name}", jsondocs.SCHEMAS[name])
    both = good.select("_pos", F.lit(None).cast("string").alias("record")).unionAll(bad.select(F.lit(None).cast("string"), "record"))
    return both.agg(F.count("_pos").alias("n_documents"), F.count_distinct("_pos").alias("n_positions"), F.count("record").alias("n_quarantined")).select(
        F.lit(folder or name).alias("document"), "n_documents", "n_positions", "n_quarantined")


def keywords_large_bank(spark: SparkSession, sf: str) -> DataFrame:
    """Documents classified by the pairs of neighbouring words of the benchmark items, each
    item a type, through the index for banks too large to try phrase by phrase (A18, C8, E7, E8, J2)."""
    w = F.split(F.lower("text"), " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    bank = (table(spark, sf, "benchmark").where(F.size(w) > 1)
            .select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("type"), F.col("item_id").cast("int").alias("type_ord"),
                    F.posexplode(F.array_distinct(pairs)).alias("kw_ord", "kw")))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return retrieve.classify(docs, bank, "text", literal=0).select("doc_id", "intent", "intent_score")


DECLARED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def source_conformance(spark: SparkSession, sf: str) -> DataFrame:
    """The declared columns of seven tables checked against their data (K4): all real rows as
    text and, beside them, one row a nation whose values are of no type, with a column
    that is declared but missing and one that is there but not declared."""
    bad = table(spark, sf, "nation")
    out = []
    for name in DECLARED:
        df = table(spark, sf, name)
        text = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))
        rows = text.unionAll(bad.select(*(F.concat(F.lit("~"), "n_name").alias(c) for c in df.columns))).withColumn("loaded_by", F.lit("run"))
        out.append(quality.conformance(name, rows, StructType([*df.schema.fields, StructField("comment", StringType())])))
    return reduce(DataFrame.unionAll, out)


def fold_stream_available(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's events, each sent twice and the files in no order, folded by two runs
    of a stream over what has arrived, the second from the first one's checkpoint; the texts as the
    stream's Parquet sink gives them back (L1)."""
    path = _folder(spark, "answer-stream")
    events = cards_catalogue._conversation_events(spark, sf)
    # every store costs each micro-batch its opening and its commit: one for 100,000 events
    stores = max(8, events.count() // 100_000)
    for turn, files in ((1, 4), (2, 8)):
        mixed = events.repartition(8, F.xxhash64("msg_id", "seq", F.lit(turn)))
        mixed.write.mode("append").parquet(f"{path}/events")
        keeper.fold_available(spark, f"{path}/events", f"{path}/texts", f"{path}/checkpoint", files=files, stores=stores)
    return keeper.latest(spark, f"{path}/texts")


def nested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their line items in pages of 100, whatever a supplier's share of the rows."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("l_quantity"), "l_returnflag")
    pages = paging.renest_pages(s, li, "s_suppkey", "l_suppkey", ["l_orderkey", "l_linenumber"],
                                ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], page_rows=100)
    return pages.select("s_suppkey", "s_name", "page", F.size("items").cast("bigint").alias("n_items"), to_json_text("items").alias("items_json"))


QUERIES = {
    "reassemble_frames": reassemble_frames,
    "index_update": index_update,
    "staged_load": staged_load,
    "evaluate_resumed": evaluate_resumed,
    "source_conformance": source_conformance,
    "documents_scan": documents_scan,
    "keywords_large_bank": keywords_large_bank,
    "fold_stream_available": fold_stream_available,
    "nested_pages": nested_pages,
}
