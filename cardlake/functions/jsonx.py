"""JSON and nested-value helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

KEEP_NULLS = {"ignoreNullFields": "false"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_json_text(c: Column | str) -> Column:
    """Struct/array/map -> JSON text, NULL fields kept as ``null`` (Spark drops them
    by default). Non-ASCII text is written as is."""
    return F.to_json(_col(c), KEEP_NULLS)


def parse_strict(c: Column | str) -> Column:
    """Text -> VARIANT; raises on malformed input (the SQL model's ``CAST AS JSON``)."""
    return F.parse_json(_col(c))


def parse_lenient(c: Column | str) -> Column:
    """Text -> VARIANT; malformed input gives NULL."""
    return F.try_parse_json(_col(c))


def decode_twice(c: Column | str, schema: DataType | str) -> Column:
    """Decode JSON into ``schema``; when the value is itself a JSON *string* holding the
    document (double encoded), decode the inner text instead. Malformed -> NULL."""
    x = _col(c)
    opts = {"mode": "PERMISSIVE"}
    v = F.try_parse_json(x)
    is_text = F.schema_of_variant(v) == "STRING"
    inner = F.when(is_text, F.variant_get(v, "$", "string"))
    return F.when(is_text, F.from_json(inner, schema, opts)).otherwise(F.from_json(x, schema, opts))


def compose_object(layout) -> Column:
    """Nested object from ``[(key, [(inner key, value column), ...]), ...]``, keys in the
    given order (H14, H18); render with :func:`to_json_text`."""
    return F.struct(*[F.struct(*[v.alias(k2) for k2, v in inner]).alias(k) for k, inner in layout])
