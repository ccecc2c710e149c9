"""DuckDB SQL twins of :mod:`cardlake.plans.events_catalogue`."""

from __future__ import annotations

from cardlake.plans.events_catalogue import NO_ANSWER, PLAN_DAYS, PLAN_TYPES
from cardlake.plans.oracle import _wide_sql
from cardlake.plans.oracle_cards import _q

EVENT_TYPE = "CASE role WHEN 'assistant' THEN 'delta' WHEN 'system' THEN 'done' ELSE 'prompt' END"
SQUARES = "list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def _snake(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9_]+', '_', 'g'), '_+', '_', 'g')"
    s = f"lower(regexp_replace({s}, '([0-9])([a-zA-Z])', '\\1_\\2', 'g'))"
    s = f"(CASE WHEN regexp_matches({s}, '^[0-9]') THEN '_' || {s} ELSE {s} END)"
    return f"(CASE WHEN length({s}) > 1 THEN regexp_replace({s}, '_$', 'x') ELSE {s} END)"


def _planning() -> str:
    days = []
    for dc, day in PLAN_DAYS.items():
        cells = ", ".join(f"{_q(name)}: CAST(plan__{dc}__{tc} AS JSON)" for tc, name in PLAN_TYPES.items())
        days.append(f"{_q(day)}: {{{cells}}}")
    return f"WITH w AS ({_wide_sql()})\nSELECT user_id, CAST(to_json({{{', '.join(days)}}}) AS VARCHAR) AS planning_json FROM w"


SQL: dict[str, str] = {
    "encode_frames": f"""
SELECT conv_id AS msg_id, turn AS seq, 'data: ' || to_json({{'type': {EVENT_TYPE}, 'text': text}}) AS frame
FROM conversations""",
    "decode_frames": f"""
SELECT conv_id AS msg_id, turn AS seq, {EVENT_TYPE} AS type, text FROM conversations""",
    "answer_events": f"""
WITH chunks AS (SELECT conv_id AS msg_id, turn AS seq, text FROM conversations WHERE role = 'assistant'),
finals AS (
  SELECT conv_id AS msg_id,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS final_text,
         CASE WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN {_q(NO_ANSWER)} END AS error
  FROM conversations GROUP BY conv_id),
last AS (SELECT msg_id, max(seq) AS last_seq FROM chunks GROUP BY msg_id)
SELECT msg_id, seq, 'delta' AS type, text FROM chunks
UNION ALL
SELECT f.msg_id, CAST(coalesce(l.last_seq, -1) + 1 AS BIGINT) AS seq,
       CASE WHEN f.error IS NOT NULL THEN 'error' ELSE 'done' END AS type, coalesce(f.error, f.final_text) AS text
FROM finals f LEFT JOIN last l ON f.msg_id = l.msg_id""",
    "first_context": """
SELECT conv_id AS msg_id, arg_min(text, turn) AS context FROM conversations
WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id""",
    "vector_normalize": f"""
WITH e AS (SELECT vec_id, embedding, sqrt({SQUARES.format(v='embedding')}) AS n FROM embeddings),
u AS (SELECT vec_id, n, CASE WHEN n > 0 THEN list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / n AS FLOAT))
                            ELSE embedding END AS unit FROM e)
SELECT vec_id, round(n, 6) AS norm_in, round(sqrt({SQUARES.format(v='unit')}), 6) AS norm_out,
       round(CAST(list_max(unit) AS DOUBLE), 6) AS max_component,
       CAST(list_position(unit, list_max(unit)) AS BIGINT) AS max_position
FROM u""",
    "snake_case_keys": f"""
WITH u AS (
  SELECT 'p_name' AS source, p_partkey AS id, p_name AS raw FROM part
  UNION ALL SELECT 'p_type', p_partkey, p_type FROM part
  UNION ALL SELECT 's_name', s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'n_name', n_nationkey, n_name FROM nation
  UNION ALL SELECT 'source', doc_id, source FROM documents)
SELECT source, CAST(id AS BIGINT) AS id, raw, {_snake('raw')} AS key FROM u""",
    "load_report": """
SELECT 'customers' AS table_name, count(*) AS rows FROM customer
UNION ALL SELECT 'customers__orders', count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
UNION ALL SELECT 'customers__orders__items', count(*)
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "compose_planning": _planning(),
    "json_unwrap": """
SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_orderstatus, strftime(o.o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""",
}
