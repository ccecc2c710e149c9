"""The six staging models (B1-B5, C1, C2, E1-E3, H14-H18) over the shredded tables.

Each child list is aggregated per parent before its LEFT JOIN (no fan-out) and ordered
by the source position ``_idx`` (the SQL models leave list order undefined).  Lists
and structs are kept as native nested columns and also rendered as real JSON text in
the ``*_json`` columns.  ``_pos`` (source order) rides along for the card lookups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardlake.functions.jsonx import parse_lenient, parse_strict, to_json_text
from cardlake.operators.nest import nest_children
from cardlake.sources.jsondocs import DAY_KEYS, SLOT_KEYS
from cardlake.operators.shred import snake_case

Tables = Mapping[str, DataFrame]

# Day names and slot names of the staged planning object, in order.
PLAN_DAYS = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi"]
PLAN_SLOTS = ["08h30_10h00", "10h15_11h45", "12h00_13h30", "13h45_15h15", "15h30_17h00"]


def _left(parent: DataFrame, agg: DataFrame, key: str = "_id") -> DataFrame:
    return parent.join(agg, parent[key] == agg["_parent_key"], "left").drop("_parent_key")


def _values(child: DataFrame, out: str) -> DataFrame:
    return nest_children(child, "_parent_id", ["_idx"], ["value"], out, scalar=True)


def stg_departments(t: Tables) -> DataFrame:
    d = t["departements"]
    return d.select(F.col("nom").alias("nom_departement"), F.col("chef_de_departement").alias("chef"),
                    F.col("description").alias("description_dept"), "_pos")


def stg_timetables(t: Tables, strict: bool = True) -> DataFrame:
    """``section`` + one planning JSON object day -> slot -> course list (H17, H18);
    strict parsing raises on malformed cell text, lenient gives NULL."""
    parse = parse_strict if strict else parse_lenient
    e = t["emplois"]
    days = []
    for day, code in zip(PLAN_DAYS, DAY_KEYS.values()):
        slots = [parse(F.col(f"emploi_du_temps__{code}__{snake_case(s)}")).alias(name)
                 for s, name in zip(SLOT_KEYS, PLAN_SLOTS)]
        days.append(F.struct(*slots).alias(day))
    plan = F.struct(*days)
    return e.where(~F.col("section").like("Template Vide%")).select(
        "section", to_json_text(plan).alias("planning_json"), "_pos")


def stg_institution(t: Tables) -> DataFrame:
    f = t["faculte"]
    tel = _values(t["faculte__contact__telephone"], "liste_telephones")
    dep = _values(t["faculte__departements_inclus"], "liste_departements")
    j = _left(_left(f, tel), dep)
    emails = F.struct(F.col("contact__emails__principal").alias("principal"),
                      F.col("contact__emails__scolarite").alias("scolarite"),
                      F.col("contact__emails__laboratoire_intelligence_artificielle").alias("laboratoire_ia"))
    loc = F.struct(F.col("localisation__ville").alias("ville"), F.col("localisation__pays").alias("pays"),
                   F.col("localisation__region").alias("region"), F.col("localisation__quartier").alias("quartier"))
    return j.select(
        "nom_officiel", "acronyme", "universite_de_rattachement", "annee_de_creation", "doyen", "vice_doyen",
        "description", F.col("contact__adresse").alias("adresse"), F.col("contact__fax").alias("fax"),
        F.col("contact__site_web").alias("site_web"), to_json_text(emails).alias("emails_json"),
        to_json_text(loc).alias("localisation_json"), to_json_text("liste_telephones").alias("telephones_json"),
        to_json_text("liste_departements").alias("departements_inclus_json"), "_pos",
    )


def stg_programmes(t: Tables) -> DataFrame:
    """cycle -> department -> programme (INNER joins), with contents (semesters with
    their modules) and research axes re-nested (C2, E3)."""
    p = "formations__departements__formations"
    mods = _values(t[f"{p}__contenu__modules"], "liste_modules")
    cont = _left(t[f"{p}__contenu"], mods)
    cont_agg = nest_children(cont, "_parent_id", ["_idx"], [F.col("annee"), F.col("semestre"),
                                                             F.col("liste_modules").alias("modules")], "contenu")
    axes = _values(t[f"{p}__axes_de_recherche"], "axes")
    m = t["formations"].select(F.col("_id").alias("m_id"), F.col("type").alias("cycle"), "_pos")
    d = t["formations__departements"].select(F.col("_id").alias("d_id"), F.col("_parent_id").alias("d_pid"),
                                             F.col("departement").alias("nom_departement"),
                                             F.col("_idx").alias("_d_idx"))
    f = t[p].select(F.col("_id"), F.col("_parent_id").alias("f_pid"), F.col("_idx").alias("_f_idx"),
                    F.col("fili_re").alias("nom_filiere"),
                    "coordonnateur", F.col("sp_cialitx").alias("specialite"), "objectifs",
                    F.col("d_bouch_s").alias("debouches"), "cible", "domaine", "description")
    j = m.join(d, m.m_id == d.d_pid).join(f, F.col("d_id") == F.col("f_pid"))
    j = _left(_left(j, cont_agg), axes)
    return j.select("cycle", "nom_departement", "nom_filiere", "coordonnateur", "specialite", "objectifs",
                    "debouches", "cible", "domaine", "description", to_json_text("contenu").alias("modules_json"),
                    to_json_text("axes").alias("axes_recherche_json"), "contenu", "axes", "_pos", "_d_idx",
                    "_f_idx")


def stg_labs(t: Tables) -> DataFrame:
    mem = nest_children(t["laboratoires__equipes__membres"], "_parent_id", ["_idx"],
                        [F.col("name").alias("nom_membre"), "role"], "liste_membres")
    teams = _left(t["laboratoires__equipes"], mem)
    team_agg = nest_children(teams, "_parent_id", ["_idx"],
                             [F.col("name").alias("nom_equipe"), F.col("liste_membres").alias("membres")], "equipes")
    labs = _left(t["laboratoires"], team_agg)
    return labs.select(F.col("title").alias("nom_laboratoire"), "acronyme", "description", "directeur",
                       "directeur_adjoint", to_json_text("equipes").alias("equipes_json"), "equipes", "_pos")


def stg_professors(t: Tables) -> DataFrame:
    em = _values(t["professeurs__email"], "emails")
    p = _left(t["professeurs"], em)
    return p.select(F.col("name").alias("nom_professeur"), F.col("status").alias("statut"), "linkedin_url",
                    to_json_text("emails").alias("emails_json"), "scopus_profile_url",
                    F.col("biography").alias("biographie"), F.col("departement_name").alias("nom_departement"),
                    "emails", "_pos")


def build_staging(t: Tables) -> dict[str, DataFrame]:
    return {
        "stg_departements": stg_departments(t),
        "stg_emplois": stg_timetables(t),
        "stg_faculte": stg_institution(t),
        "stg_formations": stg_programmes(t),
        "stg_laboratoires": stg_labs(t),
        "stg_professeurs": stg_professors(t),
    }


# Column tests of the staging models (K1, K2).
STAGING_TESTS = [
    ("stg_departements", "nom_departement", ("not_null", "unique")),
    ("stg_departements", "chef", ("not_null",)),
    ("stg_emplois", "section", ("not_null",)),
    ("stg_emplois", "planning_json", ("not_null",)),
    ("stg_faculte", "nom_officiel", ("not_null",)),
    ("stg_formations", "cycle", ("not_null",)),
    ("stg_formations", "nom_departement", ("not_null",)),
    ("stg_formations", "nom_filiere", ("not_null",)),
    ("stg_laboratoires", "nom_laboratoire", ("not_null", "unique")),
    ("stg_laboratoires", "acronyme", ("not_null", "unique")),
    ("stg_professeurs", "nom_professeur", ("not_null",)),
    ("stg_professeurs", "nom_departement", ("not_null",)),
]
