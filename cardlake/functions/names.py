"""Name and short-text helpers as Column expressions.

All of them are built-in expressions, so they stay inside the JVM and need no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardlake.functions.text import py_strip

# Title words removed before names are compared (as in the source data).
TITLE_WORDS = ["pr", "prof", "professeur", "professeure", "dr"]

# Fixed value: pattern of one leading title followed by blanks, removed for display.
LEADING_TITLE = r"(?i)^\s*(pr\.?|prof\.?|professeure?|dr\.?)\s+"

# Letters, digits and underscore in any script; everything else separates words.
# Java's plain \w is ASCII only and would destroy accented letters.
NON_WORD = r"[^\p{L}\p{N}_]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(c: Column | str) -> Column:
    """Match key for a person name: lower case, titles dropped, punctuation as blanks,
    remaining words sorted by code point and joined by one blank. NULL/'' -> ''."""
    words = F.split(F.lower(_col(c)), NON_WORD + "+")  # one pass: runs of separators split
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*TITLE_WORDS))
    return F.coalesce(F.array_join(F.sort_array(kept), " "), F.lit(""))


def format_title(c: Column | str, prefix: str = "Pr. ") -> Column:
    """Display form: one leading title stripped, ``prefix`` added. NULL/'' unchanged;
    a value that is only a title keeps its original (stripped) form."""
    x = _col(c)
    stripped = py_strip(x)
    bare = py_strip(F.regexp_replace(stripped, LEADING_TITLE, ""))
    return (
        F.when(x.isNull() | (x == ""), x)
        .when(bare != "", F.concat(F.lit(prefix), bare))
        .otherwise(stripped)
    )


def strip_quotes(c: Column | str) -> Column:
    """Remove one matching pair of single quotes around a value (after stripping)."""
    x = _col(c)
    s = py_strip(x)
    quoted = (F.length(s) >= 2) & s.startswith("'") & s.endswith("'")
    inner = py_strip(F.substring(s, F.lit(2), F.length(s) - 2))
    return F.when(x.isNull() | (x == ""), x).when(quoted, inner).otherwise(s)


def parse_list_text(c: Column | str) -> Column:
    """``'[a, b]'`` -> ``['a', 'b']``: outer brackets and blanks stripped, split on
    commas, items stripped, empty items dropped. NULL/''/'[]' -> empty array."""
    s = py_strip(F.coalesce(_col(c), F.lit("")))
    inner = py_strip(F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", ""))
    items = F.transform(F.split(inner, ","), lambda e: py_strip(e))
    return F.filter(items, lambda e: e != "")


def first_present(*cols: Column | str) -> Column:
    """First non-NULL, non-empty value, else '' (identifier choice of a card)."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def equals_ignore_case(a: Column | str, b: Column | str) -> Column:
    return F.lower(_col(a)) == F.lower(_col(b))
