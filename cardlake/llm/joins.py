"""Broadcasts behind a measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measured_broadcast(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """``df`` marked for broadcast if its rows' bytes, summed in one aggregate, stay under
    the session's broadcast limit; else ``df`` as it is, for a shuffled join.  ``df``
    should be cut or cheap, as it is read once more."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    each = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= limit else df
