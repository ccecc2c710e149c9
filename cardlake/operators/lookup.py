"""Lookups and ordered roll-ups.

The reference builds Python dicts row by row (``setdefault`` = first wins, plain
assignment = last wins).  Here a lookup is a DataFrame with one row per key, built
with ``min_by``/``max_by`` over an explicit order column: a hash aggregate with a
map-side partial phase, so a hot key never gathers its rows in one task and no sort
is needed.  Probes are LEFT joins; Catalyst/AQE broadcast the lookup when its
measured size is under the broadcast threshold and shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardlake.operators.nest import ordered_list


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pick_one(df: DataFrame, key: str | Column, order_by: Sequence[str | Column], values: Sequence[str],
             last: bool = False, skip_empty_key: bool = True) -> DataFrame:
    """One row per key: the values of the row with the smallest (``last=False``, first
    wins) or largest (``last=True``, last wins) order tuple.  Empty keys are skipped."""
    k = _c(key).alias("key") if not isinstance(key, str) else F.col(key).alias(key)
    kname = "key" if not isinstance(key, str) else key
    src = df.select(k, F.struct(*[_c(o) for o in order_by]).alias("_ord"), F.struct(*values).alias("_val"))
    if skip_empty_key:
        keep = F.col(kname).isNotNull()
        if dict(src.dtypes)[kname] == "string":
            keep = keep & (F.col(kname) != "")
        src = src.where(keep)
    pick = F.max_by if last else F.min_by
    return src.groupBy(kname).agg(pick("_val", "_ord").alias("_val")).select(kname, "_val.*")


def rollup_text(df: DataFrame, key: str | Column, order_by: Sequence[str | Column], text: str | Column,
                sep: str = "\n", out: str = "lines") -> DataFrame:
    """Ordered text roll-up per key (E4): the group's lines joined by ``sep``."""
    k = _c(key)
    return df.groupBy(k).agg(F.array_join(ordered_list(order_by, [_c(text)], scalar=True), sep).alias(out))


def join_lookup(probe: DataFrame, probe_key: str | Column, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """LEFT join a one-row-per-key lookup; probe rows are never dropped or repeated."""
    return probe.join(lookup, _c(probe_key) == lookup[lookup_key], "left")
