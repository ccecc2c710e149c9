"""DuckDB SQL twins of :mod:`cardlake.plans.store_catalogue`."""

from __future__ import annotations

from cardlake.operators.evaluate import FAILED
from cardlake.plans.oracle_cards import CORPUS, FOLD, _q, _slots
from cardlake.plans.oracle_domain import _S, LOAD
from cardlake.plans.oracle_events import EVENT_TYPE

# the driver tables' columns, those of a type other than text marked
COLUMNS = {
    "region": "r_regionkey* r_name",
    "nation": "n_nationkey* n_name n_regionkey*",
    "customer": "c_custkey* c_name c_nationkey* c_acctbal* c_mktsegment",
    "supplier": "s_suppkey* s_name s_nationkey* s_acctbal*",
    "part": "p_partkey* p_name p_brand p_type p_size* p_retailprice*",
    "orders": "o_orderkey* o_custkey* o_orderstatus o_totalprice* o_orderdate* o_orderpriority",
    "lineitem": "l_orderkey* l_partkey* l_suppkey* l_linenumber* l_quantity* l_extendedprice* l_discount* l_tax* l_returnflag l_linestatus l_shipdate*",
}


#: records of each document; a section and its empty template have one position
DOCUMENTS = {
    "faculte.json": "SELECT 2 * count(*) FROM region",
    "departements.json": "SELECT 1",
    "formations.json": "SELECT count(*) FROM region",
    "emplois_final.json": "SELECT 2 * count(DISTINCT user_id) FROM events",
    "laboratoires.json": "SELECT count(*) FROM nation",
    "professeurs.json": "SELECT (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM nation)",
    "absent.json": "SELECT 0",
}


def _conformance() -> str:
    parts = []
    for name, columns in COLUMNS.items():
        for c in columns.split():
            bad = c.endswith("*")
            parts.append(f"SELECT {_q(name)} AS table_name, {_q(c.rstrip('*'))} AS column_name, 'type' AS test, "
                         f"{'(SELECT count(*) FROM nation)' if bad else '0::BIGINT'} AS failures, '{'fail' if bad else 'pass'}' AS status")
        parts.append(f"SELECT {_q(name)}, 'comment', 'missing', (SELECT count(*) FROM {name}) + (SELECT count(*) FROM nation), 'fail'")
        parts.append(f"SELECT {_q(name)}, 'loaded_by', 'extra', 0::BIGINT, 'extra'")
    return " UNION ALL ".join(parts)


SQL: dict[str, str] = {
    "reassemble_frames": f"SELECT conv_id AS msg_id, turn AS seq, {EVENT_TYPE} AS type, text FROM conversations",
    "index_update": f"""
WITH cards AS ({CORPUS}),
slots AS (SELECT card_id, count(*) AS n FROM ({_slots('cards', 'card_id', 'page_content')}) GROUP BY card_id)
SELECT c.card_id, c.type, sha256(c.page_content) AS content_hash, coalesce(s.n, 0)::BIGINT AS n_slots
FROM cards c LEFT JOIN slots s ON c.card_id = s.card_id""",
    # the list values that are null: one a list of modules, one of a customer's four e-mails
    "staged_load": f"""
SELECT table_name, rows, rows AS rows_read, CASE table_name
         WHEN 'formations__departements__formations__contenu__modules' THEN (SELECT count(*) FROM {_S} WHERE s_suppkey % 2 = 1)
         WHEN 'professeurs__email' THEN (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 1)
         ELSE 0 END AS null_keys FROM ({LOAD})""",
    "evaluate_resumed": f"""
SELECT 'conv' || conv_id AS category, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS nth,
       turn::VARCHAR AS id_question, text AS question,
       CASE WHEN len(string_split(text, ' ')) < 4 THEN {_q(FAILED + 'trop court')} ELSE length(text)::VARCHAR END AS reponse_ia
FROM conversations""",
    "source_conformance": _conformance(),
    "documents_scan": " UNION ALL ".join(
        f"SELECT {_q(name)} AS document, n AS n_documents, n // {2 if name == 'emplois_final.json' else 1} AS n_positions, n AS n_quarantined FROM (SELECT ({count})::BIGINT AS n)"
        for name, count in DOCUMENTS.items()),
    "keywords_large_bank": """
WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
bank AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] AS kw FROM w, range(1, 10000) r(i) WHERE i < len(w)),
scores AS (SELECT doc_id, item_id, count(*) AS n FROM documents JOIN bank ON contains(lower(text), kw) GROUP BY ALL),
best AS (SELECT doc_id, item_id, n FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) = 1)
SELECT d.doc_id, 'item' || item_id AS intent, coalesce(n, 0)::BIGINT AS intent_score FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""",
    "fold_stream_available": FOLD,
    "nested_pages": """
WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, l_returnflag,
                  (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT), l_returnflag) - 1) // 100 AS page
           FROM lineitem),
p AS (SELECT l_suppkey, page, list({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_quantity': l_quantity,
                                    'l_returnflag': l_returnflag} ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) AS items
      FROM n GROUP BY l_suppkey, page)
SELECT s_suppkey, s_name, CAST(page AS BIGINT) AS page, CAST(len(items) AS BIGINT) AS n_items, CAST(to_json(items) AS VARCHAR) AS items_json
FROM supplier LEFT JOIN p ON s_suppkey = l_suppkey""",
}
