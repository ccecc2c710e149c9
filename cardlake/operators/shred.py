"""Shredding nested documents into keyed relational tables.

``shred(df, name, key_cols)`` walks the schema on the driver (the schema only, never
the data) and returns one DataFrame per nested list: the root table, one child table
per list of structs or scalars named ``parent__child``, recursively.  Roots carry
``_id``; children carry ``_id, _parent_id, _idx``.  Keys are ``sha2`` of the path and
the position, so a re-run produces the same keys (``monotonically_increasing_id`` would
not), and no shuffle is needed: every table is a narrow projection/explode of its
parent.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

SEP = "__"


def snake_case(name: str) -> str:
    """Identifier normalisation of source keys (A9): every run of characters other than
    ASCII letters, digits and ``_`` becomes one ``_``; a digit followed by a letter gets
    a ``_`` between them; lower case; a leading digit gets a ``_`` prefix and a
    trailing ``_`` becomes ``x``.  ``filière`` -> ``fili_re``, ``spécialité`` ->
    ``sp_cialitx``, ``8H30 / 10H`` -> ``_8_h30_10_h``."""
    out = re.sub(r"[^a-zA-Z0-9_]+", "_", name)
    out = re.sub(r"_+", "_", out)
    out = re.sub(r"(?<=[0-9])(?=[a-zA-Z])", "_", out).lower()
    if out[:1].isdigit():
        out = "_" + out
    if len(out) > 1 and out.endswith("_"):
        out = out[:-1] + "x"
    return out


def snake_case_col(c: Column | str) -> Column:
    """:func:`snake_case` as a column expression, for keys that arrive as data."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9_]+", "_"), "_+", "_")
    x = F.lower(F.regexp_replace(x, r"([0-9])([a-zA-Z])", "$1_$2"))
    x = F.when(x.rlike("^[0-9]"), F.concat(F.lit("_"), x)).otherwise(x)
    return F.when(F.length(x) > 1, F.regexp_replace(x, "_$", "x")).otherwise(x)


def unwrap(df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Envelope object -> one row with its fields as columns, only when present (A3);
    ``keep`` names columns beside the envelope that ride along."""
    return df.where(F.col(key).isNotNull()).select(f"{key}.*", *keep)


def unwrap_list(df: DataFrame, key: str, keep: Sequence[str] = (), pos: str | None = None) -> DataFrame:
    """Envelope holding a list -> one row per element (A4), with its position in column
    ``pos`` if that is given."""
    items = df.select(F.posexplode(F.col(key)).alias("_i", "_e"), *keep)
    return items.select("_e.*", *keep, *([F.col("_i").alias(pos)] if pos else []))


def flatten(df: DataFrame, sep: str = SEP, keep: Sequence[str] = ()) -> DataFrame:
    """Struct columns -> ``a__b__c`` columns, recursively (A5). Lists and maps stay as
    they are (they become child tables in :func:`shred`)."""
    cols: list[Column] = []

    def walk(path: list[str], dtype: DataType) -> None:
        if isinstance(dtype, StructType) and path[0] not in keep:
            for f in dtype.fields:
                walk(path + [f.name], f.dataType)
        else:
            cols.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*cols)


def _payload(dtype: DataType, prefix: str, sep: str) -> tuple[list[str], list[str]]:
    """(scalar/map column paths, list column paths) of a flattened struct."""
    scalars: list[str] = []
    lists: list[str] = []

    def walk(path: list[str], t: DataType) -> None:
        if isinstance(t, StructType):
            for f in t.fields:
                walk(path + [f.name], f.dataType)
        elif isinstance(t, ArrayType):
            lists.append(path)
        else:
            scalars.append(path)

    walk([prefix] if prefix else [], dtype)
    return scalars, lists


def _ref(path: list[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def _name(path: list[str], sep: str, skip: int = 0) -> str:
    return sep.join(path[skip:])


def row_key(*parts: Column | str) -> Column:
    """Deterministic surrogate key: sha2 over the '/'-joined parts."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("/", *[c.cast("string") for c in cols]), 256)


def shred(df: DataFrame, name: str, key_cols: Sequence[str], sep: str = SEP) -> dict[str, DataFrame]:
    """Nested DataFrame -> ``{table name: DataFrame}``.

    ``key_cols`` identify a root row (natural key); child keys derive from the parent
    key, the list's path and the element position.
    """
    tables: dict[str, DataFrame] = {}
    root = df.withColumn("_id", row_key(name, *[F.col(k) for k in key_cols]))
    root_schema = StructType([f for f in root.schema.fields])
    scalars, lists = _payload(root_schema, "", sep)
    tables[name] = root.select(*[_ref(p).alias(_name(p, sep)) for p in scalars if p != ["_id"]], "_id")
    for lp in lists:
        _shred_list(root.select(F.col("_id").alias("_pid"), _ref(lp).alias("_list")), name + sep + _name(lp, sep),
                    _name(lp, sep), _type_at(root_schema, lp), tables, sep)
    return tables


def _type_at(schema: StructType, path: list[str]) -> DataType:
    t: DataType = schema
    for p in path:
        assert isinstance(t, StructType)
        t = t[p].dataType
    return t


def _shred_list(src: DataFrame, table: str, rel: str, atype: DataType, tables: dict[str, DataFrame], sep: str) -> None:
    assert isinstance(atype, ArrayType)
    elem = atype.elementType
    exploded = src.select(
        F.col("_pid").alias("_parent_id"),
        F.posexplode(F.col("_list")).alias("_idx", "_e"),
    ).withColumn("_id", row_key(F.col("_parent_id"), F.lit(rel), F.col("_idx")))
    if isinstance(elem, StructType):
        scalars, lists = _payload(elem, "_e", sep)
        tables[table] = exploded.select(
            *[_ref(p).alias(_name(p, sep, 1)) for p in scalars], "_id", "_parent_id", "_idx"
        )
        for lp in lists:
            _shred_list(exploded.select(F.col("_id").alias("_pid"), _ref(lp).alias("_list")),
                        table + sep + _name(lp, sep, 1), _name(lp, sep, 1), _type_at(StructType([]).add("_e", elem), lp),
                        tables, sep)
    elif isinstance(elem, ArrayType):
        tables[table] = exploded.select("_id", "_parent_id", "_idx")
        _shred_list(exploded.select(F.col("_id").alias("_pid"), F.col("_e").alias("_list")), table + sep + "value",
                    "value", elem, tables, sep)
    else:
        tables[table] = exploded.select(F.col("_e").alias("value"), "_id", "_parent_id", "_idx")


def map_to_wide(
    df: DataFrame,
    map_col: str,
    outer_keys: dict[str, str],
    inner_keys: dict[str, str],
    prefix: str,
    encode: bool = True,
) -> DataFrame:
    """Map-of-maps -> fixed wide columns (A15-A17): one column per known (outer, inner)
    key pair named ``{prefix}__{outer code}__{inner code}``; unknown keys are dropped.
    A projection only: no pivot, no shuffle, duplicate keys stay separate rows."""
    out = [c for c in df.columns if c != map_col]
    cells = []
    for ok, oc in outer_keys.items():
        for ik, ic in inner_keys.items():
            v = F.try_element_at(F.try_element_at(F.col(map_col), F.lit(ok)), F.lit(ik))
            cells.append((F.to_json(v) if encode else v).alias(f"{prefix}{SEP}{oc}{SEP}{ic}"))
    return df.select(*out, *cells)
