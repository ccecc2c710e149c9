"""Whole JSON -> tables -> staging -> cards path on the hand-made documents.

Operators: A1-A17, A20, B1-B7, B9, C1-C7, E1-E4, E6, H1-H5, H12-H19, I1-I7, K1-K3.
"""

import os

import pytest

from cardlake.operators import quality
from cardlake.plans import domain_cards, staging
from cardlake.sources import jsondocs
from tests.conftest import FIXTURES


@pytest.fixture(scope="module")
def built(spark):
    import tempfile

    tables = jsondocs.shred_sources(spark, os.path.join(FIXTURES, "raw"))
    target = tempfile.mkdtemp(prefix="cardlake-load-", dir="/tmp")
    report = {r.table_name: r.rows for r in jsondocs.load_all(spark, tables, target).collect()}
    stg = staging.build_staging(jsondocs.read_tables(spark, target))
    cards = {(r.type, r.identifier): r.page_content for r in domain_cards.build_cards(stg).collect()}
    timetables = [r.page_content for r in domain_cards.timetable_cards(stg["stg_emplois"]).collect()]
    return report, stg, cards, timetables


def test_load_report(built):
    report, _, _, _ = built
    assert set(report) == set(jsondocs.TABLES)
    assert report["emplois"] == 3  # NULL, '', and Template sections dropped, duplicate kept
    assert report["formations__departements__formations"] == 3
    assert report["laboratoires__equipes__membres"] == 3


def test_missing_file(spark, scratch):
    df = jsondocs.read_json(spark, os.path.join(scratch, "absent.json"), jsondocs.SCHEMAS["professeurs.json"])
    assert df.count() == 0 and "name" in df.columns


def test_staging_models(built):
    _, stg, _, _ = built
    progs = {r.nom_filiere: r for r in stg["stg_formations"].collect()}
    assert set(progs) == {"Génie Logiciel", "Réseaux", "Mathématiques Appliquées"}  # Chimie has none
    assert progs["Génie Logiciel"].modules_json == (
        '[{"annee":"1","semestre":"S2","modules":["Java","Bases de données"]},'
        '{"annee":"1","semestre":"S1","modules":["Algorithmique",null]}]')
    assert progs["Réseaux"].modules_json is None and progs["Réseaux"].axes_recherche_json is None
    fac = stg["stg_faculte"].first()
    assert fac.telephones_json == '["05 00 00 00 02","05 00 00 00 03"]'
    assert '"laboratoire_ia":null' in fac.emails_json
    sections = sorted(r.section for r in stg["stg_emplois"].collect())
    assert sections == ["SMA S1", "SMA S1", "SMI S3"]


def test_staging_suite(built):
    _, stg, _, _ = built
    specs = [quality.Spec(t, c, tests) for t, c, tests in staging.STAGING_TESTS]
    res = {(r.table_name, r.column_name, r.test): r.failures for r in quality.run_suite(stg, specs).collect()}
    assert len(res) == 15
    assert all(v == 0 for v in res.values()), res


def test_programme_card(built):
    _, _, cards, _ = built
    c = cards[("formation", "Génie Logiciel")]
    assert "Professeur Coordonnateur / Responsable de la formation : Pr. BENTAIB MOHSSINE\n" in c
    assert "Adresse e-mail de contact du coordonnateur : m.bentaib@fse.example.org\n" in c
    # first lab listing the person wins (source order), team and director follow
    assert "Laboratoire de recherche du coordonnateur : Laboratoire de Modélisation (LMOD)\n" in c
    assert "Directeur de ce laboratoire : Pr. Mohssine Bentaib\n" in c
    plural = cards[("formation", "Mathématiques Appliquées")]
    assert "Adresses e-mail de contact du coordonnateur : s.bennani@fse.example.org, salma.bennani@fse.example.org" in plural
    bare = cards[("formation", "Réseaux")]
    assert bare == ("--- FICHE FORMATION ---\nNom de la formation / Filière : Réseaux\n"
                    "Département de rattachement : Informatique\nCycle d'étude : Licence\n")


def test_professor_lab_department_cards(built):
    _, _, cards, _ = built
    p = cards[("professeur", "Pr. Mohssine Bentaib")]
    assert "Formation(s) coordonnée(s) par ce professeur : Génie Logiciel\n" in p
    assert "Statut / Grade académique : PES\n" in p
    assert "Statut" not in cards[("professeur", "Salma Bennani")]  # blank status skipped
    lab = cards[("laboratoire", "LINF")]
    assert "Professeur Directeur du laboratoire : None\n" in lab  # unconditional field
    d = cards[("departement", "Informatique")]
    assert d.endswith("Filières et formations proposées par ce département :\n"
                      "- Licence Génie Logiciel (Coordonnateur : Pr. BENTAIB MOHSSINE)\n- Licence Réseaux\n")
    assert "Filières" not in cards[("departement", "Physique")]


def test_timetable_cards(built):
    _, _, _, tt = built
    smi = [t for t in tt if "SMI S3" in t][0]
    assert smi.endswith("- Le Lundi de 08h30 à 10h00 : [Cours] Algorithmique pour le groupe G1 (Salle: A1)\n"
                        "- Le Mardi de 10h15 à 11h45 : [TP] Java\n\n")
    sma = sorted(t for t in tt if "SMA S1" in t)
    assert len(sma) == 2
    assert any("Aucun cours programmé pour cette section." in t for t in sma)
    assert any("Vendredi de 15h30 à 17h00 : [Cours] Analyse" in t for t in sma)


def test_institution_card(built):
    _, _, cards, _ = built
    c = cards[("etablissement", "Faculté des Sciences Exemple")]
    assert "Professeur Vice-doyen" not in c  # empty value
    assert "Professeur Doyen actuel : Pr. Amina Kadiri\n" in c


def test_department_match_modes(built):
    """Exact department names by default (as the source); normalized on request."""
    from pyspark.sql import functions as F

    _, stg, _, _ = built
    progs = stg["stg_formations"].withColumn("nom_departement", F.upper("nom_departement"))
    exact = {r.identifier: r.page_content for r in domain_cards.department_cards(stg["stg_departements"], progs)
             .collect()}
    norm = {r.identifier: r.page_content for r in domain_cards.department_cards(stg["stg_departements"], progs,
                                                                                match="normalized").collect()}
    assert "Licence Génie Logiciel" not in exact["Informatique"]
    assert "- Licence Génie Logiciel (Coordonnateur : Pr. BENTAIB MOHSSINE)\n- Licence Réseaux" in norm["Informatique"]


def test_catalog_tables_are_replaced(spark, scratch):
    """Tables named in a catalog database hold the last load only."""
    spark.sql("CREATE DATABASE IF NOT EXISTS cardlake_load")
    try:
        for n in (3, 2):
            report = jsondocs.load_all(spark, {"t": spark.range(n)}, f"{scratch}/load", "cardlake_load")
            assert [(r.table_name, r.rows) for r in report.collect()] == [("t", n)]
            assert spark.table("cardlake_load.t").count() == n
    finally:
        spark.sql("DROP DATABASE cardlake_load CASCADE")


def test_added_files_leave_other_positions(spark, scratch):
    """Positions come from file name and place in the list: another file changes none."""
    import json

    def write(name, rows):
        with open(f"{scratch}/{name}", "w", encoding="utf-8") as f:
            json.dump(rows, f)

    write("b.json", [{"name": f"p{i}"} for i in range(5)])
    schema = jsondocs.SCHEMAS["professeurs.json"]
    before = {r.name: r._pos for r in jsondocs.read_positioned(spark, f"{scratch}/*.json", schema).collect()}
    write("a.json", [{"name": f"q{i}"} for i in range(50)])
    write("c.json", {"name": "alone"})
    after = {r.name: r._pos for r in jsondocs.read_positioned(spark, f"{scratch}/*.json", schema).collect()}
    assert len(after) == 56 and {k: after[k] for k in before} == before
    assert sorted(before.values()) == [before[f"p{i}"] for i in range(5)]


def test_member_rows_do_not_carry_their_team(spark):
    """a member's row holds its own name, not the whole list it comes from."""
    team = "struct<nom_equipe string, membres array<struct<nom_membre string, role string>>>"
    labs = spark.createDataFrame([
        ("1", "Lab A", "LA", "Dr A", [("T0", [("Dr. X Un", "m"), None, ("Y Deux", "m")]), None, ("T2", None), ("T3", [("Un X", "m"), ("Z", None)])]),
        ("2", "Lab B", "LB", "Dr B", [("T0", [("Y Deux", "m"), ("", "m"), (None, "m"), ("W", "m")])]),
        ("3", "Lab C", "LC", "Dr C", None),
    ], f"_pos string, nom_laboratoire string, acronyme string, directeur string, equipes array<{team}>")
    got = domain_cards.member_labs(labs)
    assert sorted(map(tuple, got.collect())) == [
        ("deux y", "Lab A", "LA", "Dr A", "T0"), ("un x", "Lab A", "LA", "Dr A", "T0"), ("w", "Lab B", "LB", "Dr B", "T0"), ("z", "Lab A", "LA", "Dr A", "T3")]
    plan = got._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().apply(0)
    carried = plan.requiredChildOutput()
    kinds = [carried.apply(i).dataType().typeName() for i in range(carried.size())]
    assert kinds and set(kinds) == {"string"}
