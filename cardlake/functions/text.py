"""Text helpers as Column expressions: e-mails, ``Label : Value`` fields, word splits
(H6, H7, H10, B11, B12, J7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: e-mail pattern used to find and check addresses (trailing dots included).
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
# The same addresses without a trailing dot, so an address that ends a sentence keeps
# its full stop outside the match (opt-in; the default above is the source's pattern).
EMAIL_NO_TRAILING_DOT = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.(?:[a-zA-Z0-9.-]*[a-zA-Z0-9-])"

# Line boundaries of Python's str.splitlines, as a Java pattern.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strip leading and trailing white space of any kind (Spark ``trim`` only removes
    the blank character)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def find_emails(c: Column | str, pattern: str = EMAIL) -> Column:
    """Every e-mail match of a text in order (repeats kept). Texts without an ``@``
    cannot match and skip the regex scan. NULL text -> empty array."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(F.instr(t, "@") > 0, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(
        F.array().cast("array<string>"))


def extract_emails(c: Column | str, pattern: str = EMAIL) -> Column:
    """Distinct e-mails of a text, sorted so that any later choice among them is
    deterministic. NULL text -> empty array."""
    return F.sort_array(F.array_distinct(find_emails(c, pattern)))


def bound(expr: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value of ``expr`` computed once, however often the body
    (or a lambda inside it) refers to it."""
    return F.get(F.transform(F.array(expr), body), 0)


def parse_fields(c: Column | str) -> Column:
    """``Label : Value`` lines -> array<struct<label, value>>; split on the first ':',
    label stripped and lower-cased, value stripped, empty ones dropped, and the first
    occurrence of a label wins (a map built from it would raise on repeats).  The pairs are
    made once and sorted by label, so the work grows with the lines, not their square."""
    lines = F.split(F.coalesce(_col(c), F.lit("")), LINE_BREAK)
    pairs = F.transform(
        F.filter(lines, lambda ln: F.instr(ln, ":") > 0),
        lambda ln, i: F.struct(
            F.lower(py_strip(F.substring_index(ln, ":", 1))).alias("label"), i.alias("pos"),
            py_strip(F.substr(ln, F.instr(ln, ":") + 1)).alias("value"),
        ),
    )
    by_label = F.sort_array(F.filter(pairs, lambda p: (p["label"] != "") & (p["value"] != "")))
    firsts = bound(by_label, lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["label"] != p["label"])))
    in_order = F.sort_array(F.transform(firsts, lambda p: F.struct(p["pos"].alias("pos"), p["label"].alias("label"), p["value"].alias("value"))))
    return F.transform(in_order, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value")))


def labelled_emails(c: Column | str, label_part: str = "mail", pattern: str = EMAIL) -> Column:
    """E-mails found in the fields whose label contains ``label_part``, in field order,
    distinct per field (one card's contact e-mails)."""
    fields = F.filter(parse_fields(c), lambda p: F.instr(p["label"], label_part) > 0)
    per_field = F.transform(fields, lambda p: extract_emails(p["value"], pattern))
    # a card without '@' has no e-mail in any field: skip parsing its lines
    return F.when(F.instr(F.coalesce(_col(c), F.lit("")), "@") > 0, F.flatten(per_field)).otherwise(
        F.array().cast("array<string>"))


def word_tokens(c: Column | str, min_len: int = 0) -> Column:
    """Split on runs of non-word characters as Python counts them; drop tokens of length
    ``<= min_len`` (empty ones always)."""
    # Python's \W: anything but a letter, a number or the underscore (Java's (?U)\W differs
    # on combining marks and on numbers such as '½')
    parts = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda t: F.length(t) > max(min_len, 0))
