"""Text cards: one ``Label : Value`` document per entity.

A card is one ``select`` over an already-joined row; optional lines are NULL when the
value is absent and ``concat_ws`` skips them, so no Python runs per row.  The corpus
schema is ``(card_id, source, type, identifier, page_content)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.functions.text import py_strip

CORPUS_COLUMNS = ["card_id", "source", "type", "identifier", "page_content"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column, numeric: bool = False) -> Column:
    """Python truthiness of a value: NULL and '' (text) or 0 (numbers) are absent."""
    x = _c(c)
    if numeric:
        return x.isNotNull() & (x != 0)
    return x.isNotNull() & (x.cast("string") != "")


def as_text(c: str | Column) -> Column:
    """How an unconditional field prints: NULL shows as ``None`` (as the source does)."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def line(label: str, value: str | Column, when: Column | None = None, blank_check: bool = False) -> Column:
    """``label : value`` if the value is present (or ``when`` holds), else NULL."""
    v = _c(value)
    cond = truthy(v) if when is None else when
    if blank_check:
        cond = cond & (py_strip(v.cast("string")) != "")
    return F.when(cond, F.concat(F.lit(f"{label} : "), v.cast("string")))


def always(label: str, value: str | Column) -> Column:
    """Unconditional line."""
    return F.concat(F.lit(f"{label} : "), as_text(value))


def plural_line(one: str, many: str, items: str | Column, sep: str = ", ") -> Column:
    """Label chosen by the list size: one item, several items, or no line."""
    xs = _c(items)
    return (
        F.when(F.size(xs) == 1, F.concat(F.lit(f"{one} : "), F.get(xs, 0)))
        .when(F.size(xs) > 1, F.concat(F.lit(f"{many} : "), F.array_join(xs, sep)))
    )


def card_text(header: str, lines: Sequence[Column]) -> Column:
    """Header and present lines, each ending with a newline."""
    return F.concat(F.concat_ws("\n", F.lit(header), *lines), F.lit("\n"))


def corpus(df: DataFrame, source: str, type_: str, id_col: str | Column, identifier: str | Column,
           content: Column) -> DataFrame:
    """Rows in corpus schema; ``card_id`` is ``type:id``."""
    return df.select(
        F.concat(F.lit(f"{type_}:"), _c(id_col).cast("string")).alias("card_id"),
        F.lit(source).alias("source"),
        F.lit(type_).alias("type"),
        _c(identifier).cast("string").alias("identifier"),
        content.alias("page_content"),
    )


def union_corpus(parts: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of card sets (G1)."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(*CORPUS_COLUMNS) for p in parts])


def corpus_counts(cards: DataFrame) -> DataFrame:
    """Cards per source (E5) and in total (E13, the row whose source is null), in one aggregate;
    cards without a source count under the empty name."""
    return cards.select(F.coalesce("source", F.lit("")).alias("source")).rollup("source").agg(F.count(F.lit(1)).alias("n_cards"))
