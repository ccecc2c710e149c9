"""Query catalogue, part 2: cards, retrieval, grounding and answer events on the driver
tables (SURVEY section 7).  SQL twins in :mod:`cardlake.plans.oracle_cards`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.names import format_title
from cardlake.functions.text import extract_emails, parse_fields
from cardlake.operators import cards, ground, nest, retrieve
from cardlake.session import cut, table
from cardlake.streaming import fold


def _money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def customer_cards(spark: SparkSession, sf: str, more: DataFrame | None = None) -> DataFrame:
    """One card per customer (and per row of ``more``); orders listed with a
    singular/plural label (B6, H13, I1-I6)."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    c = c if more is None else c.unionByName(more)
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey"))
    ords = nest.nest_children(o, "o_custkey", ["o_orderkey"], [F.col("o_orderkey").cast("string")], "orders",
                              scalar=True)
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(ords, c.c_custkey == ords._parent_key, "left")
    content = cards.card_text("--- FICHE CLIENT ---", [
        cards.always("Nom du client", "c_name"),
        cards.line("Nation", "n_name"),
        cards.line("Segment de marché", "c_mktsegment"),
        cards.line("Solde du compte", _money("c_acctbal"), when=cards.truthy("c_acctbal", numeric=True)),
        cards.plural_line("Commande passée", "Commandes passées", F.coalesce("orders", F.array().cast("array<string>"))),
    ])
    return cards.corpus(j, "customer", "client", "c_custkey", "c_name", content)


def _region_cards(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    n = table(spark, sf, "nation")
    names = nest.nest_children(n, "n_regionkey", ["n_nationkey"], ["n_name"], "nations", scalar=True)
    j = r.join(names, r.r_regionkey == names._parent_key, "left")
    content = cards.card_text("--- FICHE RÉGION ---", [
        cards.always("Nom de la région", "r_name"),
        cards.plural_line("Nation", "Nations", F.coalesce("nations", F.array().cast("array<string>"))),
    ])
    return cards.corpus(j, "region", "region", "r_regionkey", "r_name", content)


def _nation_cards(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    content = cards.card_text("--- FICHE NATION ---", [
        cards.always("Nom de la nation", "n_name"),
        cards.line("Région", "r_name"),
    ])
    return cards.corpus(j, "nation", "nation", "n_nationkey", "n_name", content)


def _supplier_cards(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    content = cards.card_text("--- FICHE FOURNISSEUR ---", [
        cards.always("Nom du fournisseur", format_title("s_name")),
        cards.line("Nation", "n_name"),
        cards.line("Solde du compte", _money("s_acctbal"), when=cards.truthy("s_acctbal", numeric=True)),
    ])
    return cards.corpus(j, "supplier", "fournisseur", "s_suppkey", "s_name", content)


def _part_cards(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    content = cards.card_text("--- FICHE PIÈCE ---", [
        cards.always("Nom de la pièce", "p_name"),
        cards.line("Marque", "p_brand"),
        cards.line("Type", "p_type"),
        cards.line("Taille", F.col("p_size").cast("string"), when=cards.truthy("p_size", numeric=True)),
    ])
    return cards.corpus(p, "part", "piece", "p_partkey", "p_name", content)


def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    """Five card types in one corpus."""
    return cards.union_corpus([
        _region_cards(spark, sf), _nation_cards(spark, sf), customer_cards(spark, sf),
        _supplier_cards(spark, sf), _part_cards(spark, sf),
    ])


def corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cards per source."""
    return cards.corpus_counts(corpus_union(spark, sf))


def cards_optional_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customer card text per customer: optional lines only when the value is present
    and not blank, singular/plural order labels (B6, B7, H13).  Beside the customers, every
    nation stands for two that lack the optional values: an empty and a missing segment."""
    n = table(spark, sf, "nation")
    odd = n.select((-2 * F.col("n_nationkey") - 1).alias("c_custkey"), F.concat(F.lit("Client "), "n_name").alias("c_name"),
                   F.col("n_nationkey").alias("c_nationkey"), F.lit("").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    odd = odd.unionAll(odd.select(F.col("c_custkey") - 1, "c_name", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("double")))
    types = dict(table(spark, sf, "customer").dtypes)
    odd = odd.select(*(F.col(c).cast(types[c]).alias(c) for c in odd.columns))
    return customer_cards(spark, sf, odd).select(F.regexp_extract("card_id", r"(-?\d+)$", 1).cast("bigint").alias("c_custkey"),
                                            "page_content")


# A small language keyword bank standing in for the intent bank; types in
# declaration order (a tie goes to the first).
LANG_BANK = {
    "en": ["the ", " and ", " of ", "tion"],
    "fr": [" le ", " la ", " des ", "tion"],
    "de": [" der ", " die ", " und ", "sch"],
    "es": [" el ", " los ", " que ", "ción"],
}


def _user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")


def intent_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword intent of every user turn, one of the bank's types."""
    q = retrieve.classify(_user_turns(spark, sf), LANG_BANK, text_col="text")
    return q.select("conv_id", "turn", retrieve.valid_intent("intent", LANG_BANK).alias("intent"), "intent_score")


def order_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question per order naming its customer and the customer's nation."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    q = F.concat(F.lit("Où en est la commande "), F.col("o_orderkey").cast("string"), F.lit(" du client Customer#"),
                 F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" de "), F.col("n_name"),
                 F.lit(" (priorité "), F.col("o_orderpriority"), F.lit(") ?"))
    return j.select(F.col("o_orderkey").alias("qid"), q.alias("question"))


def forced_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Cards named exactly (whole word) in each question: customers, then nations."""
    corpus = customer_cards(spark, sf).unionByName(_nation_cards(spark, sf))
    ids = retrieve.identifier_table(corpus, {"client": "identifier", "nation": "identifier"})
    hits = retrieve.forced_cards(order_questions(spark, sf), ids, with_content=False)
    return hits.select("qid", "index_ord", "key", "card_id")


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("qtype"), F.col("embedding").alias("qvec"))
    c = e.select(F.col("vec_id").alias("card_id"), F.col("label").alias("type"), F.col("embedding").alias("vec"))
    return q, c


def topk_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Top 4 cards of the question's type per question."""
    q, c = _vectors(spark, sf)
    return retrieve.knn(q, c, 4, typed=True).withColumn("score", F.round("score", 6))


def topk_general(spark: SparkSession, sf: str) -> DataFrame:
    """Top 3 cards over all types per question."""
    q, c = _vectors(spark, sf)
    return retrieve.knn(q, c, 3, typed=False).withColumn("score", F.round("score", 6))


def _vector_content(label_col: str, id_col: str) -> F.Column:
    return F.concat(F.lit("Vecteur "), F.col(id_col).cast("string"), F.lit(" (type "),
                    F.col(label_col).cast("string"), F.lit(")"))


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    q, c = _vectors(spark, sf)
    content = table(spark, sf, "embeddings").select(F.col("vec_id").alias("card_id"),
                                                    _vector_content("label", "vec_id").alias("page_content"))
    forced = q.select("qid", F.lit(1).alias("rank"), F.col("qid").alias("card_id"))
    typed = retrieve.knn(q, c, 4, typed=True).select("qid", "rank", "card_id")
    general = retrieve.knn(q, c, 3, typed=False).select("qid", "rank", "card_id")
    stages = [s.join(content, "card_id") for s in (forced, typed, general)]
    return retrieve.merge_ranked(stages)


def hybrid_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Forced, then typed top-4, then general top-3, duplicates removed by content in
    that order (G2, E10, J4)."""
    return _hybrid(spark, sf).select("qid", "position", "card_id", "stage")


def prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved cards of each question concatenated in order."""
    return retrieve.assemble_context(_hybrid(spark, sf))


def fields_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """``Label : Value`` fields of every customer card, first label wins (H6)."""
    c = cards_optional_lines(spark, sf)
    return c.select("c_custkey", F.posexplode(parse_fields("page_content")).alias("field_pos", "f")).select(
        "c_custkey", F.col("field_pos").cast("int").alias("field_pos"), "f.label", "f.value")


def _grounding_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    emails = extract_emails("text")
    mail_line = F.when((F.col("doc_id") % 2 == 0) & (F.size(emails) > 0),
                       F.concat(F.lit("Adresse e-mail de contact : "), F.array_join(emails, ", "), F.lit("\n")))
    card = F.concat(F.lit("--- FICHE DOCUMENT ---\nSource : "), "source", F.lit("\n"),
                    F.coalesce(mail_line, F.lit("")), F.lit("Texte : "), "text", F.lit("\n"))
    context = d.select(F.col("doc_id").alias("qid"), F.lit(0).alias("position"), F.col("source").alias("identifier"),
                       card.alias("page_content"))
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit("mail"), F.lit("MAIL"))).otherwise(
        F.replace("text", F.lit("@"), F.lit("@x")))
    answers = d.select(F.col("doc_id").alias("qid"),
                       F.concat(F.lit("Quel est le contact de la source "), "source", F.lit(" ?")).alias("question"),
                       answer.alias("answer"))
    return answers, context


def ground_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every e-mail of every (whole) answer checked against its context."""
    answers, context = _grounding_inputs(spark, sf)
    return ground.ground_answers(answers, context).withColumnRenamed("qid", "doc_id")


def ground_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict per e-mail found in the answers."""
    answers, context = _grounding_inputs(spark, sf)
    return ground.ground_audit(answers, context).withColumnRenamed("qid", "doc_id")


def _conversation_events(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    t = (F.when(F.col("role") == "assistant", "delta")
         .when((F.col("role") == "system") & (F.col("conv_id") % 2 == 0), "done")
         .when(F.col("role") == "system", "error")
         .otherwise("prompt"))
    return c.select(F.col("conv_id").alias("msg_id"), F.col("turn").alias("seq"), t.alias("type"), "text")


def fold_events(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns folded as answer events (L1)."""
    return fold.fold_events(_conversation_events(spark, sf))


def concat_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns of each conversation concatenated in order."""
    ev = _conversation_events(spark, sf).where(F.col("type") == "delta")
    return fold.concat_chunks(ev)


# Fixed value: prompt template of the ask path ({context} and {input} are filled in).
PROMPT = "Contexte fourni :\n{context}\n\nQuestion de l'utilisateur :\n{input}\n\nRéponse de l'assistant :\n"


def _text_questions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(documents as cards, user turns as questions named ``conversation:turn``)."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("card_id"), F.col("lang").alias("type"),
                                                F.col("text").alias("page_content"))
    turns = _user_turns(spark, sf).select(F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("qid"),
                                          F.col("text").alias("question"))
    return docs, turns


def _text_retrieval(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole user turns ask whole documents: hashed bag-of-words vectors (J1), keyword
    intent over the language bank (J2), typed top-4 by language and general top-3 (J4),
    duplicates removed by content.  Documents have no identifiers here."""
    docs, turns = _text_questions(spark, sf)
    cards_ = docs.withColumn("identifier", F.lit(None).cast("string"))
    return cut(retrieve.retrieve(turns, cards_, LANG_BANK, {"en": "identifier"})), turns, docs


def hybrid_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Typed then general retrieval of documents for every user turn, merged with
    duplicates removed (J1, J2, J4, C11, C12, F1, G2, E10)."""
    return _text_retrieval(spark, sf)[0]


def prompts_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt per user turn: retrieved documents in order, then the question."""
    merged, turns, docs = _text_retrieval(spark, sf)
    ctx = retrieve.assemble_context(merged.join(docs.select("card_id", "page_content"), "card_id"))
    return retrieve.fill_prompt(ctx, turns, PROMPT)


# Fixed value: keyword bank of the corpus questions, types in declaration order.
CORPUS_BANK = {
    "client": ["client", "solde"],
    "fournisseur": ["fournisseur", "solde"],
    "region": ["région"],
    "nation": ["nation"],
}


def corpus_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per customer, of four kinds: by name, by supplier, by region, without intent."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey", "n_name"),
                                          F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    supplier = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 7 + 1).cast("string"), 9, "0"))
    text = (F.when(k == 0, F.concat(F.lit("Quel est le solde du client "), F.col("c_name"), F.lit(" ?")))
            .when(k == 1, F.concat(F.lit("Le fournisseur "), supplier, F.lit(" livre-t-il en "), F.col("n_name"), F.lit(" ?")))
            .when(k == 2, F.concat(F.lit("Dans quelle région se trouve "), F.col("n_name"), F.lit(" ?")))
            .otherwise(F.concat(F.col("n_name"), F.lit(" ou "), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"))))
    return c.select(F.col("c_custkey").alias("qid"), text.alias("question"))


# Types whose cards are found by name, in index order.
CORPUS_INDEX = {"client": "identifier", "fournisseur": "identifier", "nation": "identifier", "region": "identifier"}


def retrieve_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The whole retriever over the whole corpus: cards named in the question, typed, then
    general (A21, B10, J3, J4, C9, C11, C12, E10)."""
    parts = 4 * spark.sparkContext.defaultParallelism  # small files are read by few tasks, but their cards and questions are work for all
    corpus = corpus_union(spark, sf).withColumn("position", F.regexp_extract("card_id", r"(\d+)$", 1).cast("long")).repartition(parts, "card_id")
    return retrieve.retrieve(corpus_questions(spark, sf).repartition(parts, "qid"), corpus, CORPUS_BANK, CORPUS_INDEX, order="position")


def _document_cards(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    emails = extract_emails("text")
    mail_line = F.when((F.col("doc_id") % 2 == 0) & (F.size(emails) > 0),
                       F.concat(F.lit("Adresse e-mail de contact : "), F.array_join(emails, ", "), F.lit("\n")))
    card = F.concat(F.lit("--- FICHE DOCUMENT ---\nSource : "), "source", F.lit("\n"),
                    F.coalesce(mail_line, F.lit("")), F.lit("Texte : "), "text", F.lit("\n"))
    return d.select(F.col("doc_id").alias("card_id"), F.col("lang").alias("type"), F.col("source").alias("identifier"),
                    card.alias("page_content"))


def grounded_batch(spark: SparkSession, sf: str) -> DataFrame:
    """User turns that name a source, answered by echoing the prompt with its e-mails in
    the wrong case and grounded against the retrieved cards (J10, C10, F3, J6)."""
    turns = _user_turns(spark, sf).select(
        F.concat_ws(":", F.col("conv_id"), F.col("turn")).alias("qid"),
        F.concat(F.col("text"), F.lit(" Contact de src"), (F.col("conv_id") % 20).cast("string"), F.lit(" ?")).alias("question"))
    index = {t: "identifier" for t in LANG_BANK}

    def answer(prompts: DataFrame) -> DataFrame:
        return prompts.select("qid", F.replace(F.replace("prompt", F.lit("mail"), F.lit("MAIL")), F.lit(".org"), F.lit(".net")).alias("answer"))

    out = ground.grounded_batch(turns, _document_cards(spark, sf), LANG_BANK, index, answer, PROMPT)
    return out.select("qid", "n_cards", "grounded", "changed")


QUERIES = {
    "cards_optional_lines": cards_optional_lines,
    "corpus_union": corpus_union,
    "corpus_counts": corpus_counts,
    "intent_keywords": intent_keywords,
    "forced_identifiers": forced_identifiers,
    "topk_typed": topk_typed,
    "topk_general": topk_general,
    "hybrid_merge": hybrid_merge,
    "prompt_context": prompt_context,
    "fields_first_wins": fields_first_wins,
    "ground_answers": ground_answers,
    "ground_audit": ground_audit,
    "fold_events": fold_events,
    "concat_chunks": concat_chunks,
    "hybrid_documents": hybrid_documents,
    "prompts_documents": prompts_documents,
    "retrieve_corpus": retrieve_corpus,
    "grounded_batch": grounded_batch,
}
