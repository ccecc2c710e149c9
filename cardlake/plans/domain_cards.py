"""Knowledge cards of the six staged models.

Lookups are DataFrames with one row per normalised name, built before the cards:
member -> lab (first wins), professor -> e-mails (last wins), coordinator ->
programmes (ordered list), department -> programme lines.  Empty normalised names are
never looked up.  Orders that the source leaves to storage order are made explicit:
labs, professors and programmes by their source position (``_pos`` and list
indexes) carried from the read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.functions.names import format_title, normalize_name
from cardlake.functions.text import py_strip
from cardlake.operators import cards
from cardlake.operators.lookup import pick_one
from cardlake.operators.nest import ordered_list

# Card headers and field labels (the text the answers are read from).
H_PROGRAMME = "--- FICHE FORMATION ---"
H_PROFESSOR = "--- FICHE PROFESSEUR ---"
H_LAB = "--- FICHE LABORATOIRE DE RECHERCHE ---"
H_DEPARTMENT = "--- FICHE DÉPARTEMENT ACADÉMIQUE ---"
H_TIMETABLE = "--- FICHE EMPLOI DU TEMPS ---"
H_INSTITUTION = "--- FICHE ÉTABLISSEMENT ---"
L = {
    "p_name": "Nom de la formation / Filière",
    "p_dept": "Département de rattachement",
    "p_cycle": "Cycle d'étude",
    "p_spec": "Spécialité de la formation",
    "p_coord": "Professeur Coordonnateur / Responsable de la formation",
    "p_mail1": "Adresse e-mail de contact du coordonnateur",
    "p_mailn": "Adresses e-mail de contact du coordonnateur",
    "p_lab": "Laboratoire de recherche du coordonnateur",
    "p_team": "Équipe de recherche du coordonnateur",
    "p_dir": "Directeur de ce laboratoire",
    "p_domain": "Domaine de recherche",
    "p_desc": "Description de la formation",
    "p_aims": "Objectifs pédagogiques",
    "p_jobs": "Débouchés professionnels",
    "p_public": "Public cible / Conditions d'admission",
    "p_modules": "Liste des modules enseignés",
    "p_axes": "Axes de recherche",
    "f_name": "Nom complet du professeur",
    "f_dept": "Département de rattachement",
    "f_status": "Statut / Grade académique",
    "f_mail1": "Adresse e-mail professionnelle de contact",
    "f_mailn": "Adresses e-mail professionnelles de contact",
    "f_linkedin": "Lien vers le profil professionnel LinkedIn",
    "f_scopus": "Lien vers le profil de recherche académique Scopus",
    "f_bio": "Biographie, parcours et spécialités de recherche",
    "f_lab": "Laboratoire de recherche de rattachement",
    "f_team": "Équipe de recherche",
    "f_coord": "Formation(s) coordonnée(s) par ce professeur",
    "l_name": "Nom complet du laboratoire",
    "l_acr": "Acronyme du laboratoire",
    "l_desc": "Description et mission",
    "l_dir": "Professeur Directeur du laboratoire",
    "l_dep": "Professeur Directeur Adjoint",
    "l_teams": "Liste des équipes de recherche et leurs membres",
    "d_name": "Nom du département",
    "d_head": "Professeur Chef du département",
    "d_desc": "Description et missions du département",
    "d_list": "Filières et formations proposées par ce département :",
    "d_coord": "Coordonnateur",
    "t_section": "Section / Classe concernée",
    "t_plan": "Planning complet des cours de la semaine :",
    "t_none": "Aucun cours programmé pour cette section.",
    "i_name": "Nom officiel de l'établissement",
    "i_acr": "Acronyme de la faculté",
    "i_univ": "Université de rattachement",
    "i_year": "Année de création",
    "i_dean": "Professeur Doyen actuel",
    "i_vice": "Professeur Vice-doyen actuel",
    "i_desc": "Description générale et missions de l'établissement",
    "i_addr": "Adresse postale complète",
    "i_fax": "Numéro de Fax",
    "i_web": "Site web officiel",
    "i_mail": "Adresses e-mail de contact (Administration, Scolarité, IA)",
    "i_loc": "Localisation géographique détaillée (Ville, Région, Pays)",
    "i_tel": "Numéros de téléphone officiels",
    "i_deps": "Liste des départements inclus dans la faculté",
}
COURSE_SCHEMA = "array<struct<type string, module string, groupe string, salle string>>"


def _opt(label: str, value) -> Column:
    return cards.line(L[label], value)


def _alw(label: str, value) -> Column:
    return cards.always(L[label], value)


def _clean_list(c: Column) -> Column:
    """Items stripped, NULL and empty ones dropped (list text never needs parsing)."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda e: py_strip(e)),
                    lambda e: e.isNotNull() & (e != ""))


def member_labs(labs: DataFrame) -> DataFrame:
    """member key -> (lab, acronym, director, team), first wins (C4, C5, E6).  Teams and
    members are read from the nested ``equipes`` column, never parsed back from text
    (H4)."""
    def members(t: Column, t_idx: Column) -> Column:
        return F.transform(F.coalesce(t["membres"], F.array()), lambda m, m_idx: F.struct(
            m["nom_membre"].alias("m"), t["nom_equipe"].alias("team"), t_idx.alias("t_idx"), m_idx.alias("m_idx")))

    # flat in one step: exploded team by team, every member's row would carry its whole team
    flat = F.flatten(F.transform(F.coalesce("equipes", F.array()), members))
    mem = labs.select("_pos", "nom_laboratoire", "acronyme", "directeur", F.inline(flat))
    mem = mem.select(normalize_name(F.col("m")).alias("key"), "_pos", "nom_laboratoire", "acronyme",
                     "directeur", "team", "t_idx", "m_idx")
    return pick_one(mem, "key", ["_pos", "t_idx", "m_idx"],
                    ["nom_laboratoire", "acronyme", "directeur", "team"])


def professor_emails(profs: DataFrame) -> DataFrame:
    """professor key -> e-mail list, last wins."""
    p = profs.select(normalize_name("nom_professeur").alias("key"), "_pos",
                     _clean_list(F.col("emails")).alias("mails"))
    return pick_one(p, "key", ["_pos"], ["mails"], last=True)


def _prog_order() -> list[str]:
    return ["_pos", "_d_idx", "_f_idx"]


def coordinated(programmes: DataFrame) -> DataFrame:
    """coordinator key -> programmes coordinated, in programme order."""
    p = programmes.where(F.coalesce("coordonnateur", F.lit("")) != "").select(
        normalize_name("coordonnateur").alias("key"), "nom_filiere", *_prog_order())
    p = p.where(F.col("key") != "")
    return p.groupBy("key").agg(ordered_list(_prog_order(), [F.coalesce("nom_filiere", F.lit("None"))],
                                             scalar=True).alias("programmes"))


def programme_cards(programmes: DataFrame, labs: DataFrame, profs: DataFrame) -> DataFrame:
    key = normalize_name("coordonnateur")
    p = programmes.withColumn("_key", key)
    mails = professor_emails(profs).withColumnRenamed("key", "_mk")
    lab = member_labs(labs).withColumnRenamed("key", "_lk")
    j = p.join(mails, p._key == mails._mk, "left").join(lab, p._key == lab._lk, "left")
    has_coord = cards.truthy("coordonnateur")
    has_lab = has_coord & F.col("_lk").isNotNull()
    lab_line = F.concat(F.lit(L["p_lab"] + " : "), cards.as_text("nom_laboratoire"), F.lit(" ("),
                        cards.as_text("acronyme"), F.lit(")"))
    content = cards.card_text(H_PROGRAMME, [
        _alw("p_name", "nom_filiere"), _alw("p_dept", "nom_departement"), _alw("p_cycle", "cycle"),
        _opt("p_spec", "specialite"),
        cards.line(L["p_coord"], format_title("coordonnateur"), when=has_coord),
        F.when(has_coord, cards.plural_line(L["p_mail1"], L["p_mailn"], F.coalesce("mails", F.array().cast(
            "array<string>")))),
        F.when(has_lab, lab_line),
        F.when(has_lab & cards.truthy("team"), F.concat(F.lit(L["p_team"] + " : "), F.col("team"))),
        F.when(has_lab, F.concat(F.lit(L["p_dir"] + " : "), cards.as_text(format_title("directeur")))),
        _opt("p_domain", "domaine"), _opt("p_desc", "description"), _opt("p_aims", "objectifs"),
        _opt("p_jobs", "debouches"), _opt("p_public", "cible"), _opt("p_modules", "modules_json"),
        _opt("p_axes", "axes_recherche_json"),
    ])
    return cards.corpus(j, "formations", "formation", F.sha2(content, 256), "nom_filiere", content)


def professor_cards(profs: DataFrame, labs: DataFrame, programmes: DataFrame) -> DataFrame:
    p = profs.withColumn("_key", normalize_name("nom_professeur"))
    lab = member_labs(labs).withColumnRenamed("key", "_lk")
    co = coordinated(programmes).withColumnRenamed("key", "_ck")
    j = p.join(lab, (p._key == lab._lk) & (p._key != ""), "left").join(co, (F.col("_key") == co._ck), "left")
    mails = _clean_list(F.col("emails"))
    has_lab = F.col("_lk").isNotNull()
    content = cards.card_text(H_PROFESSOR, [
        _alw("f_name", format_title("nom_professeur")),
        _opt("f_dept", "nom_departement"),
        cards.line(L["f_status"], "statut", blank_check=True),
        cards.plural_line(L["f_mail1"], L["f_mailn"], mails),
        _opt("f_linkedin", "linkedin_url"), _opt("f_scopus", "scopus_profile_url"), _opt("f_bio", "biographie"),
        F.when(has_lab, F.concat(F.lit(L["f_lab"] + " : "), cards.as_text("nom_laboratoire"), F.lit(" ("),
                                 cards.as_text("acronyme"), F.lit(")"))),
        F.when(has_lab & cards.truthy("team"), F.concat(F.lit(L["f_team"] + " : "), F.col("team"))),
        F.when(F.size(F.coalesce("programmes", F.array())) > 0,
               F.concat(F.lit(L["f_coord"] + " : "), F.array_join("programmes", ", "))),
    ])
    return cards.corpus(j, "professeurs", "professeur", F.sha2(content, 256), "nom_professeur", content)


def lab_cards(labs: DataFrame) -> DataFrame:
    content = cards.card_text(H_LAB, [
        _alw("l_name", "nom_laboratoire"), _alw("l_acr", "acronyme"), _alw("l_desc", "description"),
        _alw("l_dir", format_title("directeur")), _alw("l_dep", format_title("directeur_adjoint")),
        _alw("l_teams", "equipes_json"),
    ])
    return cards.corpus(labs, "laboratoires", "laboratoire", F.sha2(content, 256), "acronyme", content)


def department_cards(depts: DataFrame, programmes: DataFrame, match: str = "exact") -> DataFrame:
    """Departments with their programme lines (C7, E4).  Department names match exactly,
    as in the source; ``match="normalized"`` compares them by the name key used for
    people instead (case, punctuation and word order ignored)."""
    if match not in ("exact", "normalized"):
        raise ValueError(match)
    norm = normalize_name if match == "normalized" else (lambda c: c)
    coord = F.when(cards.truthy("coordonnateur"),
                   F.concat(F.lit(f" ({L['d_coord']} : "), format_title("coordonnateur"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), cards.as_text("cycle"), F.lit(" "), cards.as_text("nom_filiere"), coord)
    per = programmes.groupBy(norm(F.col("nom_departement")).alias("_dn")).agg(
        F.array_join(ordered_list(_prog_order(), [line], scalar=True), "\n").alias("lines"))
    j = depts.join(per, norm(depts["nom_departement"]) == per["_dn"], "left")
    content = cards.card_text(H_DEPARTMENT, [
        _alw("d_name", "nom_departement"), _alw("d_head", format_title("chef")), _alw("d_desc", "description_dept"),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit(L["d_list"] + "\n"), F.col("lines"))),
    ])
    return cards.corpus(j, "departements", "departement", F.sha2(content, 256), "nom_departement", content)


def timetable_cards(timetables: DataFrame) -> DataFrame:
    """One card per timetable row (duplicate sections stay separate cards); the
    planning object is decoded (a cell may hold the course list or a JSON string of
    it) and turned into lines inside the row with higher-order functions - day and
    slot order as in the object, courses without module and type skipped
    (I5, B9, H12, H19).  A projection only: no shuffle."""
    plan = F.from_json("planning_json", "map<string, map<string, string>>", {"mode": "PERMISSIVE"})

    def course_line(day, slot, c):
        details = py_strip(F.concat(
            F.when(cards.truthy(c["type"]), F.concat(F.lit("["), c["type"], F.lit("] "))).otherwise(""),
            F.when(cards.truthy(c["module"]), c["module"]).otherwise(""),
            F.when(cards.truthy(c["groupe"]), F.concat(F.lit(" pour le groupe "), c["groupe"])).otherwise(""),
            F.when(cards.truthy(c["salle"]), F.concat(F.lit(" (Salle: "), c["salle"], F.lit(")"))).otherwise(""),
        ))
        return F.concat(F.lit("- Le "), day, F.lit(" de "), F.replace(slot, F.lit("_"), F.lit(" à ")), F.lit(" : "),
                        details, F.lit("\n"))

    def slot_lines(day, s):
        courses = F.coalesce(F.from_json(s["value"], COURSE_SCHEMA), F.array())
        kept = F.filter(courses, lambda c: cards.truthy(c["module"]) | cards.truthy(c["type"]))
        return F.transform(kept, lambda c: course_line(day, s["key"], c))

    def day_lines(d):
        return F.flatten(F.transform(F.map_entries(F.coalesce(d["value"], F.create_map().cast(
            "map<string,string>"))), lambda s: slot_lines(d["key"], s)))

    lines = F.flatten(F.transform(F.map_entries(F.coalesce(plan, F.create_map().cast(
        "map<string,map<string,string>>"))), day_lines))
    text = F.array_join(lines, "")
    planning = F.when(py_strip(text) != "", text).otherwise(L["t_none"])
    content = F.concat(F.lit(H_TIMETABLE + "\n" + L["t_section"] + " : "), cards.as_text("section"),
                       F.lit("\n" + L["t_plan"] + "\n"), planning, F.lit("\n"))
    return cards.corpus(timetables, "emplois", "emploi_du_temps", F.sha2(content, 256), "section", content)


def institution_cards(fac: DataFrame) -> DataFrame:
    content = cards.card_text(H_INSTITUTION, [
        _alw("i_name", "nom_officiel"), _opt("i_acr", "acronyme"), _opt("i_univ", "universite_de_rattachement"),
        _opt("i_year", "annee_de_creation"),
        cards.line(L["i_dean"], format_title("doyen"), when=cards.truthy("doyen")),
        cards.line(L["i_vice"], format_title("vice_doyen"), when=cards.truthy("vice_doyen")),
        _opt("i_desc", "description"), _opt("i_addr", "adresse"), _opt("i_fax", "fax"), _opt("i_web", "site_web"),
        _opt("i_mail", "emails_json"), _opt("i_loc", "localisation_json"), _opt("i_tel", "telephones_json"),
        _opt("i_deps", "departements_inclus_json"),
    ])
    return cards.corpus(fac, "faculte", "etablissement", F.sha2(content, 256), "nom_officiel", content)


def build_cards(stg: Mapping[str, DataFrame]) -> DataFrame:
    """The whole corpus in the source's card order."""
    progs, profs, labs = stg["stg_formations"], stg["stg_professeurs"], stg["stg_laboratoires"]
    return cards.union_corpus([
        programme_cards(progs, labs, profs),
        professor_cards(profs, labs, progs),
        lab_cards(labs),
        department_cards(stg["stg_departements"], progs),
        timetable_cards(stg["stg_emplois"]),
        institution_cards(stg["stg_faculte"]),
    ])


# Identifier indexes of the ask path: (card type, metadata key) in lookup order.
IDENTIFIER_INDEXES = {"laboratoire": "acronyme", "emploi_du_temps": "section", "professeur": "nom",
                      "departement": "nom"}
