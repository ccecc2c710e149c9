"""Nested JSON documents -> relational tables.

Six source documents are read with explicit schemas (inference would drop a timetable
slot that happens to be absent), their keys are renamed to snake_case on the driver
(the schema only), and each is shredded into a root table and child tables with
deterministic keys.  The load writes every table with ``mode("overwrite")`` (full
replace) and reports its row count.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructField, StructType

from cardlake.session import cut
from cardlake.operators.shred import map_to_wide, shred, snake_case, unwrap, unwrap_list

log = logging.getLogger(__name__)

COURSE = "struct<type string, module string, groupe string, salle string>"

# Raw document schemas (keys as spelled in the source files).
SCHEMAS: dict[str, str] = {
    "faculte.json": (
        "faculte struct<nom_officiel string, acronyme string, universite_de_rattachement string, "
        "annee_de_creation string, doyen string, vice_doyen string, description string, "
        "contact struct<adresse string, fax string, site_web string, telephone array<string>, "
        "emails struct<principal string, scolarite string, laboratoire_intelligence_artificielle string>>, "
        "localisation struct<ville string, pays string, region string, quartier string>, "
        "departements_inclus array<string>>"
    ),
    "departements.json": "departements array<struct<nom string, chef_de_departement string, description string>>",
    "formations.json": (
        "type string, departements array<struct<departement string, formations array<struct<"
        "`filière` string, coordonnateur string, `spécialité` string, objectifs string, `débouchés` string, "
        "cible string, domaine string, description string, "
        "contenu array<struct<annee string, semestre string, modules array<string>>>, "
        "axes_de_recherche array<string>>>>>"
    ),
    "emplois_final.json": f"section string, emploi_du_temps map<string, map<string, array<{COURSE}>>>",
    "laboratoires.json": (
        "title string, acronyme string, description string, directeur string, directeur_adjoint string, "
        "equipes array<struct<name string, membres array<struct<name string, role string>>>>"
    ),
    "professeurs.json": (
        "name string, status string, linkedin_url string, email array<string>, scopus_profile_url string, "
        "biography string, departement_name string"
    ),
}

# Timetable day keys and slot keys of the source, with their column codes;
# other keys are ignored.
DAY_KEYS = {"LU": "lu", "MA": "ma", "ME": "me", "JE": "je", "VE": "ve", "SA": "sa"}
SLOT_KEYS = ["8H30 / 10H", "10H15 / 11H45", "12H / 13H30", "13H45 / 15H15", "15H30 / 17H"]

# The 16 tables of a full load.
TABLES = [
    "faculte", "faculte__contact__telephone", "faculte__departements_inclus", "departements", "formations",
    "formations__departements", "formations__departements__formations",
    "formations__departements__formations__contenu", "formations__departements__formations__contenu__modules",
    "formations__departements__formations__axes_de_recherche", "emplois", "laboratoires",
    "laboratoires__equipes", "laboratoires__equipes__membres", "professeurs", "professeurs__email",
]


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Whole-file (multi-line) JSON with an explicit schema (A1); a missing file gives
    an empty DataFrame and a warning (A2).  A top-level list gives one row per item."""
    reader = spark.read.schema(schema).option("multiLine", True).option("encoding", "UTF-8")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.warning("file not found: %s", path)
            return spark.createDataFrame([], schema)
        raise


def write_lines(docs: DataFrame, path: str) -> None:
    """Documents with their position ``_pos`` as line-delimited JSON, one record a line."""
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of line-delimited JSON with an explicit schema (A1).

    Each record carries its position ``_pos``, so files may be split, added or renamed and no
    task holds more than its share of a file.  A record that is no JSON object, has a value of
    another type or no position goes to the quarantine as it stands, ``(file, record)``; the rest are
    documents.  A missing folder gives two empty tables and a warning (A2)."""
    declared = StructType.fromDDL(schema).add("_pos", "string")
    try:
        raw = spark.read.schema(StructType([*declared.fields, StructField("_corrupt", StringType())])).option(
            "columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.warning("file not found: %s", path)
            return spark.createDataFrame([], declared), spark.createDataFrame([], "file string, record string")
        raise
    columns = [F.col(f"`{f.name}`") for f in declared.fields]
    good = raw.where("_corrupt is null and _pos is not null").select(*columns)
    bad = raw.where("_corrupt is not null or _pos is null").select(
        F.col("_metadata.file_name").alias("file"), F.coalesce("_corrupt", F.to_json(F.struct(*columns))).alias("record"))
    return good, bad


def decode_documents(df: DataFrame, text_col: str, schema: str | StructType) -> DataFrame:
    """JSON document text already in a column -> one row of the declared schema per
    document (the in-table counterpart of :func:`read_json`); malformed -> all NULL."""
    return df.select(F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"}).alias("_doc")).select("_doc.*")


def snake_type(t: DataType) -> DataType:
    """The same type with every struct field renamed to snake_case."""
    if isinstance(t, StructType):
        return StructType([StructField(snake_case(f.name), snake_type(f.dataType), f.nullable) for f in t.fields])
    if isinstance(t, ArrayType):
        return ArrayType(snake_type(t.elementType), t.containsNull)
    if isinstance(t, MapType):
        return MapType(t.keyType, snake_type(t.valueType), t.valueContainsNull)
    return t


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename all (nested) fields; struct casts are positional, so one projection does it."""
    return df.select(*[F.col(f"`{f.name}`").cast(snake_type(f.dataType)).alias(snake_case(f.name))
                       for f in df.schema.fields])


def timetable_wide(df: DataFrame) -> DataFrame:
    """Timetable rows -> ``section`` + 30 JSON-text columns (A14-A17): rows without a
    section, with an empty one or one containing ``Template`` are dropped; unknown days
    and slots are ignored.  One projection, no shuffle."""
    kept = df.where(F.col("section").isNotNull() & (F.col("section") != "") & ~F.col("section").contains("Template"))
    slot_codes = {s: snake_case(s) for s in SLOT_KEYS}
    return map_to_wide(kept, "emploi_du_temps", DAY_KEYS, slot_codes, "emploi_du_temps")


def read_positioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with their source order as ``_pos``: file name and place in the file's
    top-level list (an object is a list of one).  It is read from the data, not from the
    plan, so adding a file or splitting the scan otherwise changes no other row's position.
    A missing file gives an empty DataFrame and a warning (A2); malformed text raises."""
    empty = StructType.fromDDL(schema).add("_pos", "string")
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            log.warning("file not found: %s", path)
            return spark.createDataFrame([], empty)
        raise
    docs = F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    rows = raw.select(F.col("_metadata.file_name").alias("_f"), F.posexplode(docs).alias("_p", "_d"))
    return rows.select("_d.*", position("_f", "_p").alias("_pos"))


def position(prefix: str, index: str) -> Column:
    """Text that sorts by the prefix, then by the index."""
    return F.concat(F.col(prefix), F.lit(":"), F.lpad(F.col(index).cast("string"), 12, "0"))


def _root(df: DataFrame) -> DataFrame:
    """A document root, cut once: every child table of the root is then an explode of the
    saved rows, not a fresh parse of the JSON file."""
    return cut(df)


def shred_documents(docs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The six documents (named as in ``SCHEMAS``, each with its source order ``_pos``) as
    the 16 relational tables (A3-A9, A11, A14-A17)."""
    out: dict[str, DataFrame] = {}
    fac = _root(snake_columns(unwrap(docs["faculte.json"], "faculte", ["_pos"])))
    out.update(shred(fac, "faculte", ["nom_officiel", "_pos"]))
    items = unwrap_list(docs["departements.json"], "departements", ["_pos"], "_n")
    dep = _root(snake_columns(items.withColumn("_pos", position("_pos", "_n")).drop("_n")))
    out.update(shred(dep, "departements", ["nom", "_pos"]))
    out.update(shred(_root(snake_columns(docs["formations.json"])), "formations", ["type", "_pos"]))
    out["emplois"] = timetable_wide(docs["emplois_final.json"])
    out.update(shred(_root(snake_columns(docs["laboratoires.json"])), "laboratoires", ["title", "_pos"]))
    out.update(shred(_root(snake_columns(docs["professeurs.json"])), "professeurs", ["name", "_pos"]))
    return out


def shred_sources(spark: SparkSession, raw_dir: str, files: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The six source files as tables.  ``files`` maps a document's default name (the keys
    of ``SCHEMAS``) to its actual file name."""
    d, names = raw_dir.rstrip("/"), dict(files or {})
    return shred_documents({name: read_positioned(spark, f"{d}/{names.get(name, name)}", schema) for name, schema in SCHEMAS.items()})


def load_all(spark: SparkSession, tables: Mapping[str, DataFrame], target: str, database: str | None = None) -> DataFrame:
    """Full-replace write of every table under ``target/<name>`` (A10, A12) and a load
    report ``(table_name, rows)`` read back from the written files (A13).  With
    ``database``, the tables are also named in the catalog, as ``database.<name>``."""
    rows = []
    for name, df in tables.items():
        path = f"{target.rstrip('/')}/{name}"
        if database:
            df.write.mode("overwrite").option("path", path).format("parquet").saveAsTable(f"{database}.{name}")
        else:
            df.write.mode("overwrite").parquet(path)
        rows.append((name, spark.read.parquet(path).count()))
    return spark.createDataFrame(rows, "table_name string, rows long")


def read_tables(spark: SparkSession, target: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Staged-table scans by name."""
    return {n: spark.read.parquet(f"{target.rstrip('/')}/{n}") for n in (names or TABLES)}


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """Question file ``{category: [{id, sources, question}]}`` -> one row per question
    with its category and position (A19)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string, array<struct<id string, sources array<string>, question string>>>")
    per = raw.select(F.posexplode(F.map_entries(m)).alias("category_ord", "e"))
    return per.select("category_ord", F.col("e.key").alias("category"),
                      F.posexplode("e.value").alias("pos", "q")).select(
        "category_ord", "category", "pos", F.col("q.id").alias("id"), F.col("q.question").alias("question"),
        F.col("q.sources").alias("sources"))
