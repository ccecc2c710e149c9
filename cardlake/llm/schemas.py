"""Output schemas of Arrow functions."""

from __future__ import annotations

from pyspark.sql.types import DataType, StructField, StructType


def extended(schema: StructType, *new: tuple[str, DataType]) -> StructType:
    """``schema`` with further nullable fields; names and types of any kind stay as they are."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in new)])
