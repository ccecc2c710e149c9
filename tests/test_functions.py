"""Column helpers against hand-written expectations and a plain-Python restatement.

Operators: A9, B11, E9, F2, H1-H3, H5-H8, H10, J7.
"""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardlake.functions.names import format_title, normalize_name, parse_list_text, strip_quotes
from cardlake.functions.text import extract_emails, labelled_emails, parse_fields, py_strip


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first().y


def py_name_key(name):
    # our own statement of the rule: words = maximal runs of letters/digits/underscore,
    # lower-cased; title words dropped; sorted by code point
    if not name:
        return ""
    words = []
    cur = ""
    for ch in name.lower():
        if ch == "_" or unicodedata.category(ch)[0] in "LN":
            cur += ch
        else:
            if cur:
                words.append(cur)
            cur = ""
    if cur:
        words.append(cur)
    return " ".join(sorted(w for w in words if w not in {"pr", "prof", "professeur", "professeure", "dr"}))


def test_normalize_name_cases(spark):
    cases = {
        "Pr. Mohssine Bentaib": "bentaib mohssine",
        "BENTAIB MOHSSINE": "bentaib mohssine",
        "Dr.-Ing. Élise d'Arc": "arc d ing élise",
        "prénom Nom": "nom prénom",
        "Pr.": "",
        "Professeure X": "x",
        None: "",
        "": "",
    }
    for raw, want in cases.items():
        assert _one(spark, normalize_name, raw) == want, raw


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcéèÉDrPpofsu .-'_ÖßŁ", min_size=0, max_size=12), min_size=1, max_size=8))
def test_normalize_name_matches_python(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r.y for r in df.select(normalize_name("x").alias("y")).collect()]
    assert got == [py_name_key(n) for n in names]


def test_format_title_and_quotes(spark):
    assert _one(spark, format_title, "Dr. Salma Bennani") == "Pr. Salma Bennani"
    assert _one(spark, format_title, "  professeure  Amina ") == "Pr. Amina"
    assert _one(spark, format_title, "Youssef") == "Pr. Youssef"
    assert _one(spark, format_title, "Pr.") == "Pr. Pr."
    assert _one(spark, format_title, "") == ""
    assert _one(spark, format_title, None) is None
    assert _one(spark, strip_quotes, " 'Modélisation (MDD)' ") == "Modélisation (MDD)"
    assert _one(spark, strip_quotes, "'") == "'"


def test_parse_list_text(spark):
    assert _one(spark, parse_list_text, "[a@x.org, b@y.org]") == ["a@x.org", "b@y.org"]
    assert _one(spark, parse_list_text, "[]") == []
    assert _one(spark, parse_list_text, None) == []
    assert _one(spark, parse_list_text, "[ a , , b ]") == ["a", "b"]


def test_extract_and_fields(spark):
    text = "Nom : X\nAdresse e-mail : b@x.org, a@x.org.\nAutre mail : c@y.org\nNom : Y\nvide :\n: sans label"
    assert _one(spark, extract_emails, text) == ["a@x.org.", "b@x.org", "c@y.org"]
    fields = _one(spark, parse_fields, text)
    assert [(f.label, f.value) for f in fields] == [
        ("nom", "X"), ("adresse e-mail", "b@x.org, a@x.org."), ("autre mail", "c@y.org")]
    assert _one(spark, labelled_emails, text) == ["a@x.org.", "b@x.org", "c@y.org"]
    assert _one(spark, py_strip, "\t a b \n") == "a b"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="aZ09_ é/#-Hç", min_size=0, max_size=10), min_size=1, max_size=8))
def test_snake_case_column_matches_schema_rule(spark, names):
    from cardlake.operators.shred import snake_case, snake_case_col

    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r.y for r in df.select(snake_case_col("x").alias("y")).collect()]
    assert got == [snake_case(n) for n in names]


def test_snake_case_examples(spark):
    from cardlake.operators.shred import snake_case_col

    for raw, want in {"filière": "fili_re", "spécialité": "sp_cialitx", "8H30 / 10H": "_8_h30_10_h",
                      "UNITED STATES": "united_states", "": ""}.items():
        assert _one(spark, snake_case_col, raw) == want, raw


def test_parse_fields_grows_with_the_lines(spark):
    """Thousands of lines and values of any length: first label wins, order kept."""
    lines = [f"L{i % 700} : v{i}" for i in range(4000)] + ["big : " + "x" * 200_000, "no field", " : nothing", "empty :", "a : b : c"]
    text = "\n".join(lines)
    want = {}
    for ln in lines:
        if ":" in ln:
            k, v = ln.split(":", 1)
            if k.strip() and v.strip():
                want.setdefault(k.strip().lower(), v.strip())
    got = spark.createDataFrame([(text,)], "t string").select(parse_fields("t")).first()[0]
    assert [(g.label, g.value) for g in got] == list(want.items())
