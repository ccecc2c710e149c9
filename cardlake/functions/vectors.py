"""Vector helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double precision; for unit vectors this orders like cosine."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """Scale a vector to unit length; the zero vector stays as it is."""
    x = _col(v)
    norm = F.sqrt(dot(x, x))
    return F.when(norm > 0, F.transform(x, lambda e: (e / norm).cast("float"))).otherwise(x)
