"""DuckDB SQL twins of :mod:`cardlake.plans.domain_catalogue`, straight from the tables."""

from __future__ import annotations

from cardlake.plans import domain_cards as D
from cardlake.plans.domain_cards import L
from cardlake.plans.oracle import format_title_sql
from cardlake.plans.oracle_cards import NL, _always, _card, _opt, _plural, _q, _timetable

EMPTY = "CAST([] AS VARCHAR[])"


def _mails(k: str) -> str:
    mail = f"'c' || {k} || '@example.org'"
    return f"CASE {k} % 3 WHEN 0 THEN [{mail}] WHEN 1 THEN [{mail}, 'bis.' || {mail}] ELSE {EMPTY} END"


def _line(label: str, value: str, when: str) -> str:
    return f"CASE WHEN {when} THEN {_q(label + ' : ')} || {value} END"


COORD = "CASE WHEN s_suppkey % 4 > 0 THEN 'Dr. ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' CUSTOMER' END"

PROGRAMMES = f"""
SELECT 'formation' AS type, s_name AS identifier, {_card(D.H_PROGRAMME, [
    _always(L['p_name'], 's_name'), _always(L['p_dept'], 'n.n_name'), _always(L['p_cycle'], 'r_name'),
    _line(L['p_spec'], "'Spécialité ' || s_name", 's_suppkey % 2 = 0'),
    _line(L['p_coord'], format_title_sql('coord'), 'coord IS NOT NULL'),
    f"CASE WHEN coord IS NOT NULL AND c.c_custkey IS NOT NULL THEN {_plural(L['p_mail1'], L['p_mailn'], f'({_mails("s_suppkey")})')} END",
    _line(L['p_lab'], "'Laboratoire ' || m.n_name || ' (L' || m.n_nationkey || ')'", 'm.n_name IS NOT NULL'),
    _line(L['p_team'], 'c.c_mktsegment', 'm.n_name IS NOT NULL'),
    _line(L['p_dir'], format_title_sql("('Pr Directeur ' || m.n_name)"), 'm.n_name IS NOT NULL'),
    _line(L['p_domain'], "'Sciences'", 's_suppkey % 3 = 0'),
    _always(L['p_desc'], "'Programme ' || s_name"),
    _line(L['p_jobs'], "'Ingénieur'", 's_suppkey % 5 <> 0'), _always(L['p_public'], "'Bac'"),
    _line(L['p_modules'], """'[{"annee":"1","semestre":"S2","modules":["Module ' || s_name || '",null]},{"annee":"1","semestre":"S1","modules":null}]'""",
          's_suppkey % 2 = 1'),
    _line(L['p_axes'], """'["axe A","' || s_name || '"]'""", 's_suppkey % 3 = 0'),
])} AS page_content
FROM (SELECT *, {COORD} AS coord FROM supplier) s JOIN nation n ON s_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey
LEFT JOIN customer c ON coord IS NOT NULL AND c.c_custkey = s_suppkey LEFT JOIN nation m ON c.c_nationkey = m.n_nationkey"""

PROFESSORS = f"""
SELECT 'professeur' AS type, name AS identifier, {_card(D.H_PROFESSOR, [
    _always(L['f_name'], format_title_sql('name')), _always(L['f_dept'], 'n_name'),
    _line(L['f_status'], 'c_mktsegment', 'true'),
    _plural(L['f_mail1'], L['f_mailn'], f'({_mails("c_custkey")})'),
    _line(L['f_linkedin'], "'https://www.example.org/in/' || c_custkey", 'c_custkey % 6 <> 1'),
    _line(L['f_bio'], "'Biographie de ' || c_name", 'c_custkey % 2 = 0'),
    _always(L['f_lab'], "'Laboratoire ' || n_name || ' (L' || n_nationkey || ')'"), _always(L['f_team'], 'c_mktsegment'),
    _line(L['f_coord'], 's_name', 's_suppkey % 4 > 0'),
])} AS page_content
FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'Dr. ' || c_name ELSE c_name END AS name FROM customer)
JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'professeur', 'Invité ' || n_name, {_card(D.H_PROFESSOR, [
    _always(L['f_name'], format_title_sql("('Invité ' || n_name)")), _always(L['f_dept'], 'n_name')])} FROM nation"""

LABS = f"""
WITH teams AS (SELECT c_nationkey, c_mktsegment, '{{"nom_equipe":"' || c_mktsegment || '","membres":[' || string_agg(
    '{{"nom_membre":"' || c_name || '","role":"membre"}}', ',' ORDER BY c_custkey) || ']}}' AS team FROM customer GROUP BY 1, 2),
labs AS (SELECT c_nationkey, '[' || string_agg(team, ',' ORDER BY c_mktsegment) || ']' AS teams FROM teams GROUP BY 1)
SELECT 'laboratoire' AS type, 'L' || n_nationkey AS identifier, {_card(D.H_LAB, [
    _always(L['l_name'], "'Laboratoire ' || n_name"), _always(L['l_acr'], "'L' || n_nationkey"), _always(L['l_desc'], "'Recherche en ' || n_name"),
    _always(L['l_dir'], format_title_sql("('Pr Directeur ' || n_name)")),
    _always(L['l_dep'], f"CASE WHEN n_nationkey % 2 = 0 THEN {format_title_sql("('adjoint ' || n_name)")} END"), _always(L['l_teams'], 'teams'),
])} AS page_content
FROM nation LEFT JOIN labs ON c_nationkey = n_nationkey"""

DEPARTMENTS = f"""
WITH lines AS (SELECT s_nationkey, string_agg('- ' || r_name || ' ' || s_name || coalesce({_q(f" ({L['d_coord']} : ")} || {format_title_sql('coord')} || ')', ''),
                                              {NL} ORDER BY s_suppkey) AS lines
  FROM (SELECT *, {COORD} AS coord FROM supplier) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'departement' AS type, n_name AS identifier, {_card(D.H_DEPARTMENT, [
    _always(L['d_name'], 'n_name'),
    _always(L['d_head'], f"CASE WHEN n_nationkey % 3 > 0 THEN {format_title_sql("('Pr Chef ' || n_name)")} END"),
    _always(L['d_desc'], "'Département de ' || n_name"), f"{_q(L['d_list'])} || {NL} || lines",
])} AS page_content
FROM nation LEFT JOIN lines ON s_nationkey = n_nationkey"""

INSTITUTIONS = f"""
WITH n AS (SELECT n_regionkey, '["' || string_agg('05 ' || n_name, '","' ORDER BY n_nationkey) || '"]' AS tel,
                  '["' || string_agg(n_name, '","' ORDER BY n_nationkey) || '"]' AS deps FROM nation GROUP BY 1)
SELECT 'etablissement' AS type, r_name AS identifier, {_card(D.H_INSTITUTION, [
    _always(L['i_name'], 'r_name'), _line(L['i_acr'], 'r_name[1:3]', 'r_regionkey % 2 = 0'),
    _line(L['i_univ'], "'Université de ' || r_name", 'r_regionkey % 2 = 1'),
    _always(L['i_year'], "'19' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0')"),
    _always(L['i_dean'], format_title_sql("('Dr. Doyen ' || r_name)")),
    _line(L['i_vice'], format_title_sql("('''Vice''')"), 'r_regionkey % 2 = 0'),
    _always(L['i_desc'], "'Établissement de ' || r_name"), _always(L['i_addr'], "'1, rue Exemple'"), _always(L['i_web'], "'www.example.org'"),
    _always(L['i_mail'], """'{"principal":"contact@example.org","scolarite":null,"laboratoire_ia":"ia@example.org"}'"""),
    _always(L['i_loc'], """'{"ville":"' || r_name || '","pays":"Pays","region":"' || r_name || '","quartier":null}'"""),
    _opt(L['i_tel'], 'tel'), _opt(L['i_deps'], 'deps'),
])} AS page_content
FROM region LEFT JOIN n ON n_regionkey = r_regionkey"""

TIMETABLES = f"SELECT 'emploi_du_temps' AS type, 'user_' || user_id AS identifier, page_content FROM ({_timetable()})"

ALL = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (PROGRAMMES, PROFESSORS, LABS, DEPARTMENTS, TIMETABLES, INSTITUTIONS))

_S = "(SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_R = "(SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey)"
LOAD = " UNION ALL ".join(f"SELECT {_q(name)} AS table_name, ({count}) AS rows" for name, count in {
    "faculte": "SELECT count(*) FROM region",
    "faculte__contact__telephone": f"SELECT count(*) FROM {_R}",
    "faculte__departements_inclus": f"SELECT count(*) FROM {_R}",
    "departements": "SELECT count(*) FROM nation",
    "formations": "SELECT count(*) FROM region",
    "formations__departements": "SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey",
    "formations__departements__formations": f"SELECT count(*) FROM {_S}",
    "formations__departements__formations__contenu": f"SELECT 2 * count(*) FROM {_S} WHERE s_suppkey % 2 = 1",
    "formations__departements__formations__contenu__modules": f"SELECT 2 * count(*) FROM {_S} WHERE s_suppkey % 2 = 1",
    "formations__departements__formations__axes_de_recherche": f"SELECT 2 * count(*) FROM {_S} WHERE s_suppkey % 3 = 0",
    "emplois": "SELECT count(DISTINCT user_id) FROM events",
    "laboratoires": "SELECT count(*) FROM nation",
    "laboratoires__equipes": "SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "laboratoires__equipes__membres": "SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "professeurs": "SELECT (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM nation)",
    "professeurs__email": """SELECT sum(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END)::BIGINT
                             FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}.items())


def _suite() -> str:
    from cardlake.plans.staging import STAGING_TESTS

    missing = {("stg_departements", "chef"): "SELECT count(*) FROM nation WHERE n_nationkey % 3 = 0"}
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS table_name, {_q(c)} AS column_name, {_q(k)} AS test, n AS failures, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status "
        f"FROM (SELECT ({missing.get((t, c), 'SELECT 0::BIGINT') if k == 'not_null' else 'SELECT 0::BIGINT'}) AS n)"
        for t, c, tests in STAGING_TESTS for k in tests)


SQL: dict[str, str] = {
    "domain_load": LOAD,
    "domain_suite": _suite(),
    "programme_cards": PROGRAMMES,
    "professor_cards": PROFESSORS,
    "lab_cards": LABS,
    "department_cards": DEPARTMENTS,
    "timetable_lines": _timetable(),
    "institution_cards": INSTITUTIONS,
    "domain_corpus": f"""SELECT type, count(*) AS n_cards, count(DISTINCT identifier) AS n_identifiers, sum(length(page_content))::BIGINT AS n_chars
FROM ({ALL}) GROUP BY type""",
}
