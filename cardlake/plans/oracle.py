"""DuckDB SQL twins of the catalogue queries (same keys, same column names).

DuckDB notes: lambdas are written ``lambda x: ...``; ``\\b``/``\\w`` are ASCII there, so
word classes are spelled ``\\p{L}\\p{N}_``; ``list()`` keeps NULLs and takes ORDER BY.
"""

from __future__ import annotations

from cardlake.functions.names import TITLE_WORDS
from cardlake.plans.catalogue import DAY_CODES, QUALITY_SPECS, TYPE_CODES

TITLES_SQL = f"({', '.join(f"'{t}'" for t in TITLE_WORDS)})"


def normalize_sql(x: str) -> str:
    return (
        "coalesce(array_to_string(list_sort(list_filter(string_split(regexp_replace(lower("
        + x
        + r"), '[^\p{L}\p{N}_]', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN "
        + TITLES_SQL
        + ")), ' '), '')"
    )


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def format_title_sql(x: str) -> str:
    bare = strip_sql(f"regexp_replace({strip_sql(x)}, '^\\s*(pr\\.?|prof\\.?|professeure?|dr\\.?)\\s+', '', 'i')")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} WHEN {bare} <> '' THEN 'Pr. ' || {bare} ELSE {strip_sql(x)} END"


def strip_quotes_sql(x: str) -> str:
    s = strip_sql(x)
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} "
        f"WHEN length({s}) >= 2 AND starts_with({s}, '''') AND ends_with({s}, '''') "
        f"THEN {strip_sql(f'substring({s}, 2, length({s}) - 2)')} ELSE {s} END"
    )


def parse_list_sql(x: str) -> str:
    s = strip_sql(f"coalesce({x}, '')")
    inner = strip_sql(f"regexp_replace({s}, '^[\\[\\]]+|[\\[\\]]+$', '', 'g')")
    return (
        f"list_filter(list_transform(string_split({inner}, ','), lambda e: {strip_sql('e')}), "
        f"lambda e: e <> '')"
    )


EMAIL_SQL = "'[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+'"


def _quality_sql() -> str:
    parts = []
    for s in QUALITY_SPECS:
        if "not_null" in s.tests:
            parts.append(
                f"SELECT '{s.table}' AS table_name, '{s.column}' AS column_name, 'not_null' AS test, "
                f"CAST(count(*) FILTER (WHERE {s.column} IS NULL) AS BIGINT) AS failures FROM {s.table}"
            )
        if "unique" in s.tests:
            parts.append(
                f"SELECT '{s.table}', '{s.column}', 'unique', CAST(count(*) AS BIGINT) FROM "
                f"(SELECT {s.column} FROM {s.table} WHERE {s.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
            )
    body = "\nUNION ALL\n".join(parts)
    return (
        "SELECT table_name, column_name, test, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status "
        f"FROM ({body})"
    )


def _wide_sql() -> str:
    cols = []
    for day, dc in DAY_CODES.items():
        for et, tc in TYPE_CODES.items():
            cols.append(
                f"CAST(to_json(list(event_id ORDER BY event_id) FILTER (WHERE strftime(ts, '%a') = '{day}' "
                f"AND event_type = '{et}')) AS VARCHAR) AS plan__{dc}__{tc}"
            )
    return "SELECT user_id, " + ",\n  ".join(cols) + "\nFROM events GROUP BY user_id"


ITEMS_CTE = """items AS (
  SELECT l_orderkey,
         list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey,
               'l_quantity': CAST(l_quantity AS BIGINT), 'l_returnflag': l_returnflag, 'l_linestatus': l_linestatus}
              ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), l_returnflag, l_linestatus) AS items
  FROM lineitem GROUP BY l_orderkey)"""

SQL: dict[str, str] = {
    "renest_two_level": f"""
WITH {ITEMS_CTE},
ords AS (
  SELECT o.o_custkey,
         list({{'o_orderkey': o.o_orderkey, 'o_orderstatus': o.o_orderstatus, 'o_orderpriority': o.o_orderpriority,
                'o_orderdate': strftime(o.o_orderdate, '%Y-%m-%d'), 'items': i.items}} ORDER BY o.o_orderkey) AS orders
  FROM orders o LEFT JOIN items i ON o.o_orderkey = i.l_orderkey GROUP BY o.o_custkey)
SELECT c.c_custkey, c.c_name, CAST(len(d.orders) AS BIGINT) AS n_orders, CAST(to_json(d.orders) AS VARCHAR) AS orders_json
FROM customer c LEFT JOIN ords d ON c.c_custkey = d.o_custkey""",
    "hierarchy_inner": """
SELECT r.r_name, n.n_name, c.c_custkey, c.c_name
FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON n.n_nationkey = c.c_nationkey""",
    "childless_parent_null": """
SELECT o.o_orderkey, o.o_custkey, CAST(len(i.lines) AS BIGINT) AS n_items, CAST(to_json(i.lines) AS VARCHAR) AS linenumbers_json
FROM orders o LEFT JOIN (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS lines
                         FROM lineitem GROUP BY l_orderkey) i ON o.o_orderkey = i.l_orderkey""",
    "shred_children": """
WITH x AS (
  SELECT l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS BIGINT) AS l_quantity, o.o_orderkey,
         row_number() OVER (PARTITION BY o.o_orderkey
                            ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS BIGINT)) - 1 AS idx
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey)
SELECT l_linenumber, l_partkey, l_suppkey, l_quantity,
       sha256(sha256('orders/' || o_orderkey) || '/items/' || idx) AS _id,
       sha256('orders/' || o_orderkey) AS _parent_id, CAST(idx AS INTEGER) AS _idx
FROM x""",
    "flatten_struct": """
SELECT c.c_custkey, c.c_name AS customer__c_name, c.c_mktsegment AS customer__c_mktsegment,
       n.n_name AS customer__nation__n_name, r.r_name AS customer__nation__region__r_name
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "map_lookup_wide": _wide_sql(),
    "json_strict_lenient": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k_strict,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k_lenient, CAST(json_extract(props, '$.k') AS BIGINT) AS k_double
FROM events""",
    "prefix_filter": """
SELECT p_partkey, p_name, p_type FROM part
WHERE p_name NOT LIKE 'small%' AND coalesce(p_type, '') <> '' AND NOT contains(p_type, 'PROMO')""",
    "quality_suite": _quality_sql(),
    "normalize_names": f"""
WITH n AS (
  SELECT 'part' AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer
  UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations)
SELECT source, id, {normalize_sql('name')} AS name_key FROM n""",
    "format_title": f"""
WITH s AS (
  SELECT s_suppkey, unnest([s_name, 'Dr. ' || s_name, 'pr ' || lower(s_name), '  Professeure ' || s_name || ' ',
                            '''' || s_name || '''', 'Dr.']) AS raw
  FROM supplier)
SELECT s_suppkey, raw, {format_title_sql('raw')} AS display, {strip_quotes_sql('raw')} AS unquoted FROM s""",
    "parse_list_text": f"""
WITH p AS (
  SELECT p_partkey, unnest(['[' || p_brand || ', ' || p_type || ', , ' || p_name || ']', '[ ' || p_brand || ' ]', '[]', NULL]) AS raw
  FROM part)
SELECT p_partkey, raw, CAST(len({parse_list_sql('raw')}) AS BIGINT) AS n_items,
       CAST(to_json({parse_list_sql('raw')}) AS VARCHAR) AS items_json FROM p""",
    "lookup_first_wins": """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders WHERE o_custkey IS NOT NULL) WHERE rn = 1""",
    "lookup_last_wins": """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_custkey IS NOT NULL) WHERE rn = 1""",
    "entity_join": f"""
WITH probe AS (
  SELECT o_orderkey, 'Dr. ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' CUSTOMER' AS coord FROM orders),
people AS (
  SELECT name_key, c_custkey, c_mktsegment FROM (
    SELECT {normalize_sql('c_name')} AS name_key, c_custkey, c_mktsegment,
           row_number() OVER (PARTITION BY {normalize_sql('c_name')} ORDER BY c_custkey DESC) AS rn
    FROM customer) WHERE rn = 1 AND name_key <> '')
SELECT p.o_orderkey, {format_title_sql('p.coord')} AS coordinator, {normalize_sql('p.coord')} AS name_key,
       pe.c_custkey, pe.c_mktsegment
FROM probe p LEFT JOIN people pe ON {normalize_sql('p.coord')} = pe.name_key""",
    "rollup_text": """
SELECT l_orderkey,
       string_agg('- ' || l_linenumber || ' : part ' || l_partkey || ' x ' || CAST(l_quantity AS BIGINT), chr(10)
                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS lines
FROM lineitem GROUP BY l_orderkey""",
    "extract_emails": f"""
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_emails, CAST(to_json(e) AS VARCHAR) AS emails_json FROM (
  SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), {EMAIL_SQL}))) AS e FROM documents)""",
    "reject_blank": f"""
SELECT conv_id, turn,
       CASE WHEN coalesce({strip_sql("text")}, '') <> '' THEN 'valid' ELSE 'rejected' END AS status
FROM conversations UNION ALL SELECT conv_id, turn, 'rejected' FROM conversations""",
    "latency_by_category": """
SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean_value, round(quantile_cont(value, 0.5), 2) AS median_value,
       round(min(value), 2) AS min_value, round(max(value), 2) AS max_value
FROM events GROUP BY event_type""",
}
