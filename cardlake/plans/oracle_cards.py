"""DuckDB SQL twins of :mod:`cardlake.plans.cards_catalogue`."""

from __future__ import annotations

from cardlake.plans.cards_catalogue import CORPUS_BANK, CORPUS_INDEX, LANG_BANK, PROMPT
from cardlake.plans.domain_cards import L
from cardlake.plans.oracle import EMAIL_SQL, format_title_sql, strip_sql
from cardlake.plans.slots import DAY_NAMES, SLOTS

NL = "chr(10)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def _opt(label: str, v: str, cond: str | None = None) -> str:
    cond = cond or f"coalesce(CAST({v} AS VARCHAR), '') <> ''"
    return f"CASE WHEN {cond} THEN {_q(label + ' : ')} || CAST({v} AS VARCHAR) END"


def _always(label: str, v: str) -> str:
    return f"{_q(label + ' : ')} || coalesce(CAST({v} AS VARCHAR), 'None')"


def _plural(one: str, many: str, lst: str) -> str:
    return (f"CASE WHEN len({lst}) = 1 THEN {_q(one + ' : ')} || {lst}[1] "
            f"WHEN len({lst}) > 1 THEN {_q(many + ' : ')} || array_to_string({lst}, ', ') END")


def _card(header: str, lines: list[str]) -> str:
    return f"concat_ws({NL}, {_q(header)}, " + ", ".join(lines) + f") || {NL}"


CUSTOMER_CARDS = f"""
SELECT 'client:' || c.c_custkey AS card_id, 'customer' AS source, 'client' AS type, c.c_name AS identifier,
  {_card('--- FICHE CLIENT ---', [
      _always('Nom du client', 'c.c_name'),
      _opt('Nation', 'n.n_name'),
      _opt('Segment de marché', 'c.c_mktsegment'),
      _opt('Solde du compte', _money('c.c_acctbal'), 'c.c_acctbal IS NOT NULL AND c.c_acctbal <> 0'),
      _plural('Commande passée', 'Commandes passées', "coalesce(o.orders, CAST([] AS VARCHAR[]))"),
  ])} AS page_content,
  c.c_custkey
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS orders
           FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey"""

# two customers a nation that lack the optional values
_ODD_CUSTOMERS = """(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer
  UNION ALL SELECT -2 * n_nationkey - 1, 'Client ' || n_name, n_nationkey, '', 0 FROM nation
  UNION ALL SELECT -2 * n_nationkey - 2, 'Client ' || n_name, NULL, NULL, NULL FROM nation)"""
OPTIONAL_CARDS = CUSTOMER_CARDS.replace("FROM customer c", f"FROM {_ODD_CUSTOMERS} c")

REGION_CARDS = f"""
SELECT 'region:' || r.r_regionkey AS card_id, 'region' AS source, 'region' AS type, r.r_name AS identifier,
  {_card('--- FICHE RÉGION ---', [
      _always('Nom de la région', 'r.r_name'),
      _plural('Nation', 'Nations', "coalesce(x.nations, CAST([] AS VARCHAR[]))"),
  ])} AS page_content
FROM region r LEFT JOIN (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS nations FROM nation
                         GROUP BY n_regionkey) x ON r.r_regionkey = x.n_regionkey"""

NATION_CARDS = f"""
SELECT 'nation:' || n.n_nationkey AS card_id, 'nation' AS source, 'nation' AS type, n.n_name AS identifier,
  {_card('--- FICHE NATION ---', [_always('Nom de la nation', 'n.n_name'), _opt('Région', 'r.r_name')])} AS page_content
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

SUPPLIER_CARDS = f"""
SELECT 'fournisseur:' || s.s_suppkey AS card_id, 'supplier' AS source, 'fournisseur' AS type, s.s_name AS identifier,
  {_card('--- FICHE FOURNISSEUR ---', [
      _always('Nom du fournisseur', format_title_sql('s.s_name')),
      _opt('Nation', 'n.n_name'),
      _opt('Solde du compte', _money('s.s_acctbal'), 's.s_acctbal IS NOT NULL AND s.s_acctbal <> 0'),
  ])} AS page_content
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"""

PART_CARDS = f"""
SELECT 'piece:' || p_partkey AS card_id, 'part' AS source, 'piece' AS type, p_name AS identifier,
  {_card('--- FICHE PIÈCE ---', [
      _always('Nom de la pièce', 'p_name'), _opt('Marque', 'p_brand'), _opt('Type', 'p_type'),
      _opt('Taille', 'p_size', 'p_size IS NOT NULL AND p_size <> 0'),
  ])} AS page_content
FROM part"""

CORPUS = f"""
SELECT card_id, source, type, identifier, page_content FROM ({REGION_CARDS})
UNION ALL SELECT card_id, source, type, identifier, page_content FROM ({NATION_CARDS})
UNION ALL SELECT card_id, source, type, identifier, page_content FROM ({CUSTOMER_CARDS})
UNION ALL SELECT card_id, source, type, identifier, page_content FROM ({SUPPLIER_CARDS})
UNION ALL SELECT card_id, source, type, identifier, page_content FROM ({PART_CARDS})"""


def _timetable() -> str:
    day_case = "CASE strftime(ts, '%a') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DAY_NAMES.items()) + " END"
    ord_case = "CASE strftime(ts, '%a') " + " ".join(
        f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(DAY_NAMES)) + " ELSE 0 END"
    minute = "(hour(ts) * 60 + minute(ts))"
    slot_case = "CASE " + " ".join(f"WHEN {minute} >= {lo} AND {minute} < {hi} THEN '{n}'" for n, lo, hi in SLOTS) + " END"
    grp = "CASE WHEN event_type <> 'view' THEN 'G' || (user_id % 3 + 1) END"
    room = "CASE WHEN event_type <> 'click' THEN 'S' || (event_id % 20) END"
    module = "'k' || json_extract_string(props, '$.k')"
    details = strip_sql(
        "CASE WHEN coalesce(event_type, '') <> '' THEN '[' || event_type || '] ' ELSE '' END || "
        f"coalesce({module}, '') || "
        f"CASE WHEN coalesce({grp}, '') <> '' THEN ' pour le groupe ' || {grp} ELSE '' END || "
        f"CASE WHEN coalesce({room}, '') <> '' THEN ' (Salle: ' || {room} || ')' ELSE '' END")
    return f"""
WITH e AS (
  SELECT user_id, ts, event_id, {ord_case} AS d, {slot_case} AS s, {day_case} AS day, {details} AS details
  FROM events),
l AS (
  SELECT user_id,
         string_agg('- Le ' || day || ' de ' || replace(s, '_', ' à ') || ' : ' || details || {NL}, ''
                    ORDER BY d, s, ts, event_id) FILTER (WHERE d > 0 AND s IS NOT NULL) AS planning
  FROM e GROUP BY user_id)
SELECT user_id, '--- FICHE EMPLOI DU TEMPS ---' || {NL} || 'Section / Classe concernée : user_' || user_id || {NL}
       || 'Planning complet des cours de la semaine :' || {NL} || coalesce(planning, {_q(L["t_none"])}) || {NL}
       AS page_content
FROM l"""


def _bank_values(bank: dict[str, list[str]] = LANG_BANK) -> str:
    rows = []
    for i, (t, kws) in enumerate(bank.items()):
        for kw in kws:
            rows.append(f"({_q(t)}, {i}, {_q(kw)})")
    return ", ".join(rows)


INTENT = f"""
WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS lq FROM conversations WHERE role = 'user'),
bank(type, type_ord, kw) AS (VALUES {_bank_values()}),
types AS (SELECT DISTINCT type, type_ord FROM bank),
s AS (SELECT q.conv_id, q.turn, t.type, t.type_ord,
             (SELECT count(*) FROM bank b WHERE b.type = t.type AND contains(q.lq, b.kw)) AS score
      FROM q CROSS JOIN types t),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, type_ord) AS rn FROM s)
SELECT conv_id, turn, CASE WHEN score > 0 THEN type END AS intent, CAST(score AS BIGINT) AS intent_score
FROM b WHERE rn = 1"""

FORCED = f"""
WITH q AS (
  SELECT o.o_orderkey AS qid,
         lower('Où en est la commande ' || o.o_orderkey || ' du client Customer#' || lpad(CAST(o.o_custkey AS VARCHAR), 9, '0')
               || ' de ' || n.n_name || ' (priorité ' || o.o_orderpriority || ') ?') AS lq
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
ids0 AS (
  SELECT 0 AS index_ord, lower({strip_sql('c_name')}) AS key, 'client:' || c_custkey AS card_id FROM customer
  UNION ALL SELECT 1, lower({strip_sql('n_name')}), 'nation:' || n_nationkey FROM nation),
ids AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY index_ord, key ORDER BY card_id DESC) AS rn FROM ids0
                       WHERE coalesce(key, '') <> '') WHERE rn = 1),
cand AS MATERIALIZED (SELECT q.qid, q.lq, i.index_ord, i.key, i.card_id FROM q JOIN ids i ON contains(q.lq, i.key))
SELECT qid, CAST(index_ord AS INTEGER) AS index_ord, key, card_id
FROM cand WHERE regexp_matches(lq, '\\b' || regexp_escape(key) || '\\b')"""


def _knn(k: int, typed: bool) -> str:
    on = "q.label = c.label" if typed else "TRUE"
    return f"""
SELECT qid, CAST(rnk AS INTEGER) AS rank, card_id, round(score, 6) AS score FROM (
  SELECT q.vec_id AS qid, c.vec_id AS card_id,
         list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY q.vec_id
                            ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC,
                                     c.vec_id) AS rnk
  FROM embeddings q JOIN embeddings c ON {on}) WHERE rnk <= {k}"""


HYBRID = f"""
WITH forced AS (SELECT vec_id AS qid, 0 AS stage, 1 AS rank, vec_id AS card_id FROM embeddings),
typed AS (SELECT qid, 1 AS stage, rank, card_id FROM ({_knn(4, True)})),
general AS (SELECT qid, 2 AS stage, rank, card_id FROM ({_knn(3, False)})),
a AS (SELECT * FROM forced UNION ALL SELECT * FROM typed UNION ALL SELECT * FROM general),
c AS (SELECT a.*, 'Vecteur ' || e.vec_id || ' (type ' || e.label || ')' AS page_content
      FROM a JOIN embeddings e ON a.card_id = e.vec_id),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, page_content ORDER BY stage, rank, card_id) AS rn
                     FROM c) WHERE rn = 1),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY stage, rank, card_id) - 1 AS INTEGER) AS position FROM d)"""

HYBRID_MERGE = HYBRID + "\nSELECT qid, position, card_id, CAST(stage AS INTEGER) AS stage FROM m"
PROMPT_CONTEXT = HYBRID + f"\nSELECT qid, string_agg(page_content, {NL} || {NL} ORDER BY position) AS context FROM m GROUP BY qid"

FIELDS = f"""
WITH cards AS ({OPTIONAL_CARDS}),
lines AS (SELECT c_custkey, generate_subscripts(string_split(page_content, {NL}), 1) AS li,
                 unnest(string_split(page_content, {NL})) AS ln FROM cards),
f AS (SELECT c_custkey, li, lower({strip_sql("split_part(ln, ':', 1)")}) AS label,
             {strip_sql("substring(ln, strpos(ln, ':') + 1)")} AS value
      FROM lines WHERE strpos(ln, ':') > 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, label ORDER BY li) AS rn FROM f
                     WHERE label <> '' AND value <> '') WHERE rn = 1)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY li) - 1 AS INTEGER) AS field_pos, label, value
FROM k"""


def _emails(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(coalesce({x}, ''), {EMAIL_SQL})))"


GROUND_BASE = f"""
WITH d AS (SELECT doc_id, source, text, {_emails('text')} AS emails FROM documents),
c AS (
  SELECT doc_id, source,
         '--- FICHE DOCUMENT ---' || {NL} || 'Source : ' || source || {NL}
         || CASE WHEN doc_id % 2 = 0 AND len(emails) > 0
                 THEN 'Adresse e-mail de contact : ' || array_to_string(emails, ', ') || {NL} ELSE '' END
         || 'Texte : ' || text || {NL} AS card,
         CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, 'mail', 'MAIL') ELSE replace(text, '@', '@x') END AS answer,
         lower('Quel est le contact de la source ' || source || ' ?') AS lq
  FROM d),
lines AS (SELECT doc_id, generate_subscripts(string_split(card, {NL}), 1) AS li, unnest(string_split(card, {NL})) AS ln
          FROM c),
f AS (SELECT doc_id, li, lower({strip_sql("split_part(ln, ':', 1)")}) AS label,
             {strip_sql("substring(ln, strpos(ln, ':') + 1)")} AS value FROM lines WHERE strpos(ln, ':') > 0),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY li) AS rn FROM f
                      WHERE label <> '' AND value <> '') WHERE rn = 1),
tg AS (SELECT doc_id, flatten(list({_emails('value')} ORDER BY li)) AS target FROM fk
       WHERE contains(label, 'mail') GROUP BY doc_id),
sc AS (SELECT doc_id, len(list_filter(list_filter(string_split_regex(lower(source), '[^\\p{{L}}\\p{{N}}_]+'),
                                                  lambda t: length(t) > 2), lambda t: contains(lq, t))) AS score FROM c),
g AS (
  SELECT c.doc_id, c.answer, {_emails('c.card')} AS valid,
         CASE WHEN sc.score > 0 THEN coalesce(tg.target, CAST([] AS VARCHAR[])) ELSE CAST([] AS VARCHAR[]) END AS target
  FROM c JOIN sc ON c.doc_id = sc.doc_id LEFT JOIN tg ON c.doc_id = tg.doc_id)"""

UNVERIFIED_SQL = "'[adresse e-mail non vérifiée - voir la fiche source]'"


def _fix(m: str) -> str:
    same = f"list_filter(valid, lambda v: lower(v) = lower({m}))"
    return (f"CASE WHEN list_contains(valid, {m}) THEN {m} WHEN len({same}) > 0 THEN {same}[1] "
            f"WHEN len(target) = 1 THEN target[1] WHEN len(target) > 1 THEN array_to_string(target, ' / ') "
            f"WHEN len(valid) = 1 THEN valid[1] ELSE {UNVERIFIED_SQL} END")


GROUND_ANSWERS = GROUND_BASE + f"""
, r AS (
  SELECT doc_id, answer, valid,
         CASE WHEN len(valid) = 0 THEN answer ELSE array_to_string(list_transform(
           list_zip(string_split_regex(answer, {EMAIL_SQL}),
                    list_concat(list_transform(regexp_extract_all(answer, {EMAIL_SQL}), lambda m: {_fix('m')}), [''])),
           lambda x: x[1] || x[2]), '') END AS grounded
  FROM g)
SELECT doc_id, grounded, NOT coalesce(grounded = answer, FALSE) AS changed FROM r"""

GROUND_AUDIT = GROUND_BASE + f"""
, x AS (SELECT doc_id, valid, target, generate_subscripts(regexp_extract_all(answer, {EMAIL_SQL}), 1) - 1 AS pos,
               unnest(regexp_extract_all(answer, {EMAIL_SQL})) AS email FROM g)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, email,
       CASE WHEN len(valid) = 0 THEN 'no_context' WHEN list_contains(valid, email) THEN 'exact'
            WHEN len(list_filter(valid, lambda v: lower(v) = lower(email))) > 0 THEN 'case'
            WHEN len(target) > 0 THEN 'target' WHEN len(valid) = 1 THEN 'single' ELSE 'unverified' END AS verdict,
       CASE WHEN len(valid) = 0 THEN email ELSE {_fix('email')} END AS replacement
FROM x"""

EVENTS = """
e AS (SELECT conv_id AS msg_id, turn AS seq,
             CASE WHEN role = 'assistant' THEN 'delta' WHEN role = 'system' AND conv_id % 2 = 0 THEN 'done'
                  WHEN role = 'system' THEN 'error' ELSE 'prompt' END AS type, text FROM conversations)"""

FOLD = f"""
WITH {EVENTS},
r AS (SELECT msg_id, max(seq) FILTER (WHERE type IN ('done', 'error')) AS rs FROM e GROUP BY msg_id),
b AS (SELECT e.msg_id, CASE WHEN e.type = 'error' THEN {_q('Désolé, une erreur est survenue : ')} || coalesce(e.text, '')
                            ELSE coalesce(e.text, '') END AS btext
      FROM e JOIN r ON e.msg_id = r.msg_id AND e.seq = r.rs),
t AS (SELECT e.msg_id, string_agg(coalesce(e.text, ''), '' ORDER BY e.seq) AS tail
      FROM e JOIN r ON e.msg_id = r.msg_id WHERE e.type = 'delta' AND (r.rs IS NULL OR e.seq > r.rs) GROUP BY e.msg_id)
SELECT r.msg_id, CASE WHEN b.btext IS NULL AND t.tail IS NULL THEN NULL ELSE coalesce(b.btext, '') || coalesce(t.tail, '') END
       AS text
FROM r LEFT JOIN b ON r.msg_id = b.msg_id LEFT JOIN t ON r.msg_id = t.msg_id"""

CONCAT = f"""
WITH {EVENTS}
SELECT msg_id, string_agg(text, '' ORDER BY seq) AS answer FROM e WHERE type = 'delta' GROUP BY msg_id"""

GAPS = "'[^\\p{L}\\p{N}_]+'"


def _slots(source: str, id_: str, text: str) -> str:
    """Occurrences per hashed slot of each text's words."""
    return f"""
SELECT {id_}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot, count(*) AS n
FROM (SELECT {id_}, unnest(string_split_regex(lower(coalesce({text}, '')), {GAPS})) AS w FROM {source}) WHERE w <> '' GROUP BY ALL"""


def _retriever(cards: str, questions: str, bank: dict[str, list[str]], index: list[str], k: int = 4, fallback: int = 3) -> str:
    """CTEs from cards (card_id, type, identifier, page_content, ord) and questions (qid,
    question) to m (qid, position, card_id, stage)."""
    index_values = ", ".join(f"({_q(t)}, {i})" for i, t in enumerate(index))
    return f"""
cards AS MATERIALIZED ({cards}),
q AS MATERIALIZED ({questions}),
cs AS MATERIALIZED ({_slots('cards', 'card_id', 'page_content')}),
qs AS MATERIALIZED ({_slots('q', 'qid', 'question')}),
cl AS (SELECT card_id, sqrt(sum(n * n)) AS l FROM cs GROUP BY card_id),
ql AS (SELECT qid, sqrt(sum(n * n)) AS l FROM qs GROUP BY qid),
dots AS (SELECT qid, card_id, sum(qs.n * cs.n) AS d FROM qs JOIN cs USING (slot) GROUP BY qid, card_id),
bank(type, type_ord, kw) AS (VALUES {_bank_values(bank)}),
hits AS (SELECT qid, type, type_ord, count(*) FILTER (contains(lower(coalesce(question, '')), kw)) AS hits FROM q, bank GROUP BY ALL),
intent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, type_ord) AS rn FROM hits) WHERE rn = 1 AND hits > 0),
scores AS MATERIALIZED (
  SELECT q.qid, c.card_id, c.type, round(coalesce(d / (ql.l * cl.l), 0), 9) AS score FROM q CROSS JOIN cards c
  LEFT JOIN dots ON dots.qid = q.qid AND dots.card_id = c.card_id LEFT JOIN ql ON ql.qid = q.qid LEFT JOIN cl ON cl.card_id = c.card_id),
typed AS (SELECT s.qid, s.card_id, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, card_id) AS rank
          FROM scores s JOIN intent i ON s.qid = i.qid AND s.type = i.type),
general AS (SELECT qid, card_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, card_id) AS rank FROM scores),
ix(type, index_ord) AS (VALUES {index_values}),
ids AS (SELECT index_ord, lower({strip_sql('identifier')}) AS key, arg_max(card_id, ord) AS card_id, min(ord) AS key_ord
        FROM cards JOIN ix USING (type) WHERE lower({strip_sql('identifier')}) <> '' GROUP BY ALL),
cand AS MATERIALIZED (SELECT qid, lower(question) AS lq, ids.* FROM q JOIN ids ON contains(lower(question), key)),
forced AS (SELECT qid, card_id, row_number() OVER (PARTITION BY qid ORDER BY index_ord, key_ord, key) AS rank
           FROM cand WHERE regexp_matches(lq, '\\b' || regexp_escape(key) || '\\b')),
stages AS (SELECT qid, 0 AS stage, rank, card_id FROM forced UNION ALL SELECT qid, 1, rank, card_id FROM typed WHERE rank <= {k}
           UNION ALL SELECT qid, 2, rank, card_id FROM general WHERE rank <= {fallback}),
firsts AS (SELECT stages.*, row_number() OVER (PARTITION BY qid, coalesce('=' || page_content, '') ORDER BY stage, rank, card_id) AS rn
           FROM stages JOIN cards USING (card_id)),
m AS MATERIALIZED (SELECT qid, card_id, stage, CAST(row_number() OVER (PARTITION BY qid ORDER BY stage, rank, card_id) - 1 AS INTEGER) AS position
      FROM firsts WHERE rn = 1)"""


TURNS = "SELECT conv_id || ':' || turn AS qid, text AS question FROM conversations WHERE role = 'user'"
DOCUMENTS = _retriever("SELECT doc_id AS card_id, lang AS type, NULL::VARCHAR AS identifier, text AS page_content, doc_id AS ord FROM documents",
                       TURNS, LANG_BANK, ["en"])
HYBRID_DOCUMENTS = f"WITH {DOCUMENTS} SELECT qid, position, card_id, stage FROM m"


def _prompt(context: str, question: str) -> str:
    return f"replace(replace({_q(PROMPT)}, '{{context}}', coalesce({context}, '')), '{{input}}', coalesce({question}, ''))"


_CONTEXT = "SELECT qid, string_agg(page_content, chr(10) || chr(10) ORDER BY position) AS context FROM m JOIN cards USING (card_id) GROUP BY qid"
PROMPTS_DOCUMENTS = f"""
WITH {DOCUMENTS}, ctx AS ({_CONTEXT})
SELECT q.qid, {_prompt('context', 'question')} AS prompt FROM q LEFT JOIN ctx USING (qid)"""

CORPUS_QUESTIONS = """
SELECT c_custkey AS qid, CASE c_custkey % 4
  WHEN 0 THEN 'Quel est le solde du client ' || c_name || ' ?'
  WHEN 1 THEN 'Le fournisseur Supplier#' || lpad(CAST(c_custkey % 7 + 1 AS VARCHAR), 9, '0') || ' livre-t-il en ' || n_name || ' ?'
  WHEN 2 THEN 'Dans quelle région se trouve ' || n_name || ' ?'
  ELSE n_name || ' ou ' || c_name || ', ' || c_mktsegment END AS question
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
RETRIEVE_CORPUS = f"""
WITH {_retriever(f"SELECT *, CAST(regexp_extract(card_id, '([0-9]+)$', 1) AS BIGINT) AS ord FROM ({CORPUS})", CORPUS_QUESTIONS, CORPUS_BANK, list(CORPUS_INDEX))}
SELECT qid, position, card_id, stage FROM m"""

_DOCUMENT_CARDS = f"""
SELECT doc_id AS card_id, lang AS type, source AS identifier, doc_id AS ord,
       '--- FICHE DOCUMENT ---' || {NL} || 'Source : ' || source || {NL}
       || CASE WHEN doc_id % 2 = 0 AND len({_emails('text')}) > 0
               THEN 'Adresse e-mail de contact : ' || array_to_string({_emails('text')}, ', ') || {NL} ELSE '' END
       || 'Texte : ' || text || {NL} AS page_content FROM documents"""
_SOURCE_TURNS = "SELECT conv_id || ':' || turn AS qid, text || ' Contact de src' || (conv_id % 20) || ' ?' AS question FROM conversations WHERE role = 'user'"
GROUNDED_BATCH = f"""
WITH {_retriever(_DOCUMENT_CARDS, _SOURCE_TURNS, LANG_BANK, list(LANG_BANK))},
ctx AS ({_CONTEXT}),
found AS (SELECT qid, position, identifier, card_id, {_emails('page_content')} AS emails FROM m JOIN cards USING (card_id)),
valid AS (SELECT qid, list_sort(list_distinct(flatten(list(emails)))) AS valid FROM found GROUP BY qid),
lines AS (SELECT card_id, generate_subscripts(string_split(page_content, {NL}), 1) AS li, unnest(string_split(page_content, {NL})) AS ln
          FROM cards WHERE card_id IN (SELECT card_id FROM m)),
f AS (SELECT card_id, li, lower({strip_sql("split_part(ln, ':', 1)")}) AS label, {strip_sql("substring(ln, strpos(ln, ':') + 1)")} AS value
      FROM lines WHERE strpos(ln, ':') > 0),
fk AS (SELECT *, row_number() OVER (PARTITION BY card_id, label ORDER BY li) AS rn FROM f WHERE label <> '' AND value <> ''),
contact AS (SELECT card_id, flatten(list({_emails('value')} ORDER BY li)) AS emails FROM fk WHERE rn = 1 AND contains(label, 'mail') GROUP BY card_id),
score AS (SELECT found.*, len(list_filter(list_filter(string_split_regex(lower(identifier), {GAPS}), lambda t: length(t) > 2),
                                          lambda t: contains(lower(question), t))) AS score FROM found JOIN q USING (qid)),
target AS (SELECT s.qid, coalesce(contact.emails, CAST([] AS VARCHAR[])) AS target
           FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rn FROM score WHERE score > 0) s
           LEFT JOIN contact USING (card_id) WHERE rn = 1),
g AS (SELECT q.qid, replace(replace({_prompt('context', 'question')}, 'mail', 'MAIL'), '.org', '.net') AS answer,
             coalesce(valid.valid, CAST([] AS VARCHAR[])) AS valid, coalesce(target.target, CAST([] AS VARCHAR[])) AS target
      FROM q LEFT JOIN ctx USING (qid) LEFT JOIN valid USING (qid) LEFT JOIN target USING (qid)),
n AS (SELECT qid, count(*) AS n_cards FROM m GROUP BY qid),
r AS (SELECT qid, answer, CASE WHEN len(valid) = 0 THEN answer ELSE array_to_string(list_transform(
        list_zip(string_split_regex(answer, {EMAIL_SQL}),
                 list_concat(list_transform(regexp_extract_all(answer, {EMAIL_SQL}), lambda m: {_fix('m')}), [''])),
        lambda x: x[1] || x[2]), '') END AS grounded FROM g)
SELECT r.qid, coalesce(n_cards, 0) AS n_cards, grounded, NOT coalesce(grounded = answer, FALSE) AS changed FROM r LEFT JOIN n USING (qid)"""

SQL: dict[str, str] = {
    "cards_optional_lines": f"SELECT c_custkey, page_content FROM ({OPTIONAL_CARDS})",
    "corpus_union": CORPUS,
    "corpus_counts": f"SELECT source, count(*) AS n_cards FROM ({CORPUS}) GROUP BY ROLLUP (source)",
    "intent_keywords": INTENT,
    "forced_identifiers": FORCED,
    "topk_typed": _knn(4, True),
    "topk_general": _knn(3, False),
    "hybrid_merge": HYBRID_MERGE,
    "prompt_context": PROMPT_CONTEXT,
    "fields_first_wins": FIELDS,
    "ground_answers": GROUND_ANSWERS,
    "ground_audit": GROUND_AUDIT,
    "fold_events": FOLD,
    "concat_chunks": CONCAT,
    "hybrid_documents": HYBRID_DOCUMENTS,
    "prompts_documents": PROMPTS_DOCUMENTS,
    "retrieve_corpus": RETRIEVE_CORPUS,
    "grounded_batch": GROUNDED_BATCH,
}
