"""Query catalogue, part 4: the whole domain path on the driver tables.

The tables are nested into the six document shapes of the sources, and from there the
library does the rest: shred into 16 tables, stage the six models, test them, build the
cards (A3-A17, B1-B9, C1-C7, E1-E6, H1-H20, I1-I7, K1-K3).  Nations are departments and
labs, regions are cycles and institutions, suppliers are programmes, customers are
professors, and users' events are timetables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.functions.names import first_present
from cardlake.operators import quality
from cardlake.plans import domain_cards, staging
from cardlake.plans.slots import DAY_NAMES, SLOTS
from cardlake.session import cut, table
from cardlake.sources import jsondocs


def _pos(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _sorted(order: str, item: Column) -> Column:
    """Items of a group as an array in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda e: e["x"])


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The document columns cast to the declared schema, as a decoded file has them."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(jsondocs.SCHEMAS[name]).fields
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields], "_pos")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(_sorted("n_nationkey", F.col("n_name")).alias("nations"))
    r = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    odd = F.col("r_regionkey") % 2 == 1
    body = F.struct(
        F.col("r_name").alias("nom_officiel"), F.when(odd, F.lit("")).otherwise(F.substring("r_name", 1, 3)).alias("acronyme"),
        F.when(odd, F.concat(F.lit("Université de "), "r_name")).alias("universite_de_rattachement"),
        F.concat(F.lit("19"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0")).alias("annee_de_creation"),
        F.concat(F.lit("Dr. Doyen "), "r_name").alias("doyen"), F.when(odd, F.lit("")).otherwise(F.lit("'Vice'")).alias("vice_doyen"),
        F.concat(F.lit("Établissement de "), "r_name").alias("description"),
        F.struct(F.lit("1, rue Exemple").alias("adresse"), F.lit(None).cast("string").alias("fax"), F.lit("www.example.org").alias("site_web"),
                 F.transform(F.col("nations"), lambda x: F.concat(F.lit("05 "), x)).alias("telephone"),
                 F.struct(F.lit("contact@example.org").alias("principal"), F.lit(None).cast("string").alias("scolarite"),
                          F.lit("ia@example.org").alias("laboratoire_intelligence_artificielle")).alias("emails")).alias("contact"),
        F.struct(F.col("r_name").alias("ville"), F.lit("Pays").alias("pays"), F.col("r_name").alias("region"),
                 F.lit(None).cast("string").alias("quartier")).alias("localisation"),
        F.col("nations").alias("departements_inclus"))
    full = r.select(body.alias("faculte"), _pos("r_regionkey").alias("_pos"))
    # beside each document comes one with an empty envelope
    empty = r.select(F.lit(None).cast(full.schema["faculte"].dataType).alias("faculte"), F.concat(F.lit("e"), _pos("r_regionkey")).alias("_pos"))
    return full.unionAll(empty)


def _departments(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("n_name").alias("nom"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("Pr Chef "), "n_name")).alias(
        "chef_de_departement"), F.concat(F.lit("Département de "), "n_name").alias("description"))
    return table(spark, sf, "nation").agg(_sorted("n_nationkey", item).alias("departements")).withColumn("_pos", F.lit("d"))


def _programmes(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    coord = F.when(k % 4 > 0, F.concat(F.lit("Dr. "), F.lpad(k.cast("string"), 9, "0"), F.lit(" CUSTOMER")))
    parts = F.array(F.concat(F.lit("Module "), name), F.lit(None).cast("string"))
    contents = F.array(F.struct(F.lit("1").alias("annee"), F.lit("S2").alias("semestre"), parts.alias("modules")),
                       F.struct(F.lit("1").alias("annee"), F.lit("S1").alias("semestre"), F.lit(None).cast("array<string>").alias("modules")))
    item = F.struct(
        name.alias("filière"), coord.alias("coordonnateur"), F.when(k % 2 == 0, F.concat(F.lit("Spécialité "), name)).alias("spécialité"),
        F.lit(None).cast("string").alias("objectifs"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("Ingénieur")).alias("débouchés"),
        F.lit("Bac").alias("cible"), F.when(k % 3 == 0, F.lit("Sciences")).alias("domaine"), F.concat(F.lit("Programme "), name).alias("description"),
        F.when(k % 2 == 1, contents).alias("contenu"), F.when(k % 3 == 0, F.array(F.lit("axe A"), name)).alias("axes_de_recherche"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(_sorted("s_suppkey", item).alias("formations"))
    n = table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    dept = F.struct(F.col("n_name").alias("departement"), F.col("formations"))
    d = n.groupBy("n_regionkey").agg(_sorted("n_nationkey", dept).alias("departements"))
    r = table(spark, sf, "region").join(d, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select(F.col("r_name").alias("type"), "departements", _pos("r_regionkey").alias("_pos"))


def _timetables(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the events, with their weekday codes (Sunday's ``DI`` too) and slots."""
    ev = table(spark, sf, "events")
    codes = dict(zip([*DAY_NAMES, "Sun"], [*jsondocs.DAY_KEYS, "DI"], strict=True))
    day = F.element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.date_format("ts", "EEE"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    slot = F.lit(None).cast("string")
    for (_, lo, hi), key in zip(SLOTS, jsondocs.SLOT_KEYS, strict=True):
        slot = F.when((minute >= lo) & (minute < hi), F.lit(key)).otherwise(slot)
    course = F.struct(
        F.col("event_type").alias("type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("module"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("G"), (F.col("user_id") % 3 + 1).cast("string"))).alias("groupe"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("S"), (F.col("event_id") % 20).cast("string"))).alias("salle"))
    at = ev.select("user_id", day.alias("day"), F.coalesce(slot, F.lit("nuit")).alias("slot"), F.struct("ts", "event_id").alias("o"), course.alias("c"))
    cells = at.groupBy("user_id", "day", "slot").agg(_sorted("o", F.col("c")).alias("courses"))
    days = cells.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("slot", "courses"))).alias("slots"))
    users = days.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "slots"))).alias("emploi_du_temps"))
    rows = users.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("section"), "emploi_du_temps", _pos("user_id").alias("_pos"))
    # every section also comes as an empty template, which the load leaves out
    template = rows.select(F.concat(F.lit("Template Vide "), "section").alias("section"), "emploi_du_temps", "_pos")
    return rows.unionAll(template)


def _labs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    member = F.struct(F.col("c_name").alias("name"), F.lit("membre").alias("role"))
    teams = c.groupBy("c_nationkey", "c_mktsegment").agg(_sorted("c_custkey", member).alias("membres"))
    team = F.struct(F.col("c_mktsegment").alias("name"), F.col("membres"))
    labs = teams.groupBy("c_nationkey").agg(_sorted("c_mktsegment", team).alias("equipes"))
    n = table(spark, sf, "nation").join(labs, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(
        F.concat(F.lit("Laboratoire "), "n_name").alias("title"), F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("acronyme"),
        F.concat(F.lit("Recherche en "), "n_name").alias("description"), F.concat(F.lit("Pr Directeur "), "n_name").alias("directeur"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("adjoint "), "n_name")).alias("directeur_adjoint"), "equipes",
        _pos("n_nationkey").alias("_pos"))


def _professors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    mail = F.concat(F.lit("c"), k.cast("string"), F.lit("@example.org"))
    mails = (F.when(k % 3 == 0, F.array(F.concat(F.lit(" "), mail, F.lit(" "))))
             .when(k % 3 == 1, F.array(mail, F.lit(" "), F.concat(F.lit("bis."), mail), F.lit(None).cast("string"))))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    guests = table(spark, sf, "nation").select(  # of no lab, with a blank status
        F.concat(F.lit("Invité "), "n_name").alias("name"), F.lit("  ").alias("status"), *(F.lit(None).cast("string").alias(x) for x in ("linkedin_url",)),
        F.array().cast("array<string>").alias("email"), *(F.lit(None).cast("string").alias(x) for x in ("scopus_profile_url", "biography")),
        F.col("n_name").alias("departement_name"), F.concat(F.lit("g"), _pos("n_nationkey")).alias("_pos"))
    return guests.unionAll(c.select(
        F.when(k % 5 == 0, F.concat(F.lit("Dr. "), "c_name")).otherwise(F.col("c_name")).alias("name"),
        F.col("c_mktsegment").alias("status"),
        F.when(k % 6 != 1, F.concat(F.lit("https://www.example.org/in/"), k.cast("string"))).alias("linkedin_url"),
        mails.alias("email"), F.lit(None).cast("string").alias("scopus_profile_url"),
        F.when(k % 2 == 0, F.concat(F.lit("Biographie de "), "c_name")).alias("biography"), F.col("n_name").alias("departement_name"),
        _pos("c_custkey").alias("_pos")))


def documents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    makers = {"faculte.json": _regions, "departements.json": _departments, "formations.json": _programmes,
              "emplois_final.json": _timetables, "laboratoires.json": _labs, "professeurs.json": _professors}
    return {name: _typed(make(spark, sf), name) for name, make in makers.items()}


def _tables(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    """The relational tables of the named documents; the other documents are empty."""
    docs = {k: v if k in names or not names else v.limit(0) for k, v in documents(spark, sf).items()}
    return jsondocs.shred_documents(docs)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("type", "identifier", "page_content")


def domain_load(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each of the 16 relational tables of the six documents."""
    out = None
    for name, df in _tables(spark, sf).items():
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = n if out is None else out.unionAll(n)
    return out


def domain_suite(spark: SparkSession, sf: str) -> DataFrame:
    """Every column test of the staged models."""
    stg = staging.build_staging(_tables(spark, sf))
    return quality.run_suite(stg, [quality.Spec(t, c, tests) for t, c, tests in staging.STAGING_TESTS])


def programme_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Programme cards."""
    t = _tables(spark, sf, "formations.json", "laboratoires.json", "professeurs.json")
    return _shown(domain_cards.programme_cards(staging.stg_programmes(t), staging.stg_labs(t), staging.stg_professors(t)))


def professor_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Professor cards."""
    t = _tables(spark, sf, "formations.json", "laboratoires.json", "professeurs.json")
    return _shown(domain_cards.professor_cards(staging.stg_professors(t), staging.stg_labs(t), staging.stg_programmes(t)))


def lab_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Lab cards."""
    return _shown(domain_cards.lab_cards(staging.stg_labs(_tables(spark, sf, "laboratoires.json"))))


def department_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Department cards."""
    t = _tables(spark, sf, "formations.json", "departements.json")
    return _shown(domain_cards.department_cards(staging.stg_departments(t), staging.stg_programmes(t)))


def timetable_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One timetable card per user: one line per event that falls in a known day and slot,
    in day, slot and time order; templates, unknown days and slots left out (I5, A14-A17,
    B5, B9, H12, H17-H19)."""
    t = _tables(spark, sf, "emplois_final.json")
    out = domain_cards.timetable_cards(staging.stg_timetables(t))
    return out.select(F.regexp_extract("identifier", r"(\d+)$", 1).cast("bigint").alias("user_id"), "page_content")


def institution_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Institution cards."""
    return _shown(domain_cards.institution_cards(staging.stg_institution(_tables(spark, sf, "faculte.json"))))


def domain_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Cards, distinct identifiers and characters per type of the whole domain corpus."""
    stg = staging.build_staging(_tables(spark, sf))
    corpus = cut(domain_cards.build_cards(stg))
    return corpus.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_cards"), F.count_distinct(first_present("identifier", "type")).alias("n_identifiers"),
        F.sum(F.length("page_content")).alias("n_chars"))


QUERIES = {
    "domain_load": domain_load,
    "domain_suite": domain_suite,
    "programme_cards": programme_cards,
    "professor_cards": professor_cards,
    "lab_cards": lab_cards,
    "department_cards": department_cards,
    "timetable_lines": timetable_lines,
    "institution_cards": institution_cards,
    "domain_corpus": domain_corpus,
}
