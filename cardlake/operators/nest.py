"""Re-nesting: child rows folded into an ordered list on their parent.

The pattern of every staging model: aggregate the children by parent key *first*
(partial aggregation before the shuffle, one row per parent after it), then LEFT JOIN
the parent, so rows never fan out. A parent without children gets NULL, not ``[]``.

Scale notes
-----------
* ``collect_list`` runs as ObjectHashAggregate with a map-side partial phase, so the
  shuffle carries one partial list per (task, parent) instead of every child row.
* The aggregate output is hash partitioned on the parent key, and the join on that key
  reuses that partitioning: one exchange per side per level.
* A parent's list is one value in one row; its size is bounded by that parent's child
  count, which is the output the model defines.  Use :func:`cardlake.operators.shred`
  to go back to flat rows, which is unbounded-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_list(order_by: Sequence[str | Column], fields: Sequence[str | Column], scalar: bool = False,
                 keep: Column | None = None) -> Column:
    """Aggregate: the group's rows as an ordered list.

    Each element is packed as ``struct(order keys..., value)`` before ``collect_list``,
    which keeps NULL values (a bare ``collect_list`` drops them) and lets
    ``sort_array`` (native, no lambda comparator) order by the keys; the keys are projected away afterwards.
    ``scalar=True`` with one field gives ``array<field type>`` instead of
    ``array<struct>``.  Rows failing ``keep`` are left out inside the (partial)
    aggregate, before the shuffle; a group with none kept gives ``[]``.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in fields]
    keys_named, fields_named = _names(order_by), _names(fields)
    if not scalar and keys_named and fields_named and keys_named == fields_named[: len(keys_named)]:
        # the order keys are the leading fields: sort the value structs themselves and
        # ship each field once
        packed = F.struct(*cols)
        return F.sort_array(F.collect_list(packed if keep is None else F.when(keep, packed)))
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_k{i}") for i, c in enumerate(order_by)]
    value = cols[0] if scalar else F.struct(*cols)
    packed = F.struct(*keys, value.alias("_v"))
    packed = packed if keep is None else F.when(keep, packed)  # collect_list skips the NULLs
    return F.transform(F.sort_array(F.collect_list(packed)), lambda e: e["_v"])


def _names(cols: Sequence[str | Column]) -> list[str] | None:
    """Plain column names, or None when any item is an expression."""
    return [c for c in cols] if all(isinstance(c, str) for c in cols) else None


def nest_children(
    child: DataFrame,
    fk: str,
    order_by: Sequence[str | Column],
    fields: Sequence[str | Column],
    out: str,
    scalar: bool = False,
) -> DataFrame:
    """``SELECT fk, list(fields ORDER BY order_by) AS out FROM child GROUP BY fk``."""
    return child.groupBy(F.col(fk).alias("_parent_key")).agg(ordered_list(order_by, fields, scalar).alias(out))


def renest(
    parent: DataFrame,
    child: DataFrame,
    key: str,
    fk: str,
    order_by: Sequence[str | Column],
    fields: Sequence[str | Column],
    out: str,
    scalar: bool = False,
) -> DataFrame:
    """Parent LEFT JOIN (children of each parent as one ordered list ``out``)."""
    agg = nest_children(child, fk, order_by, fields, out, scalar)
    return parent.join(agg, parent[key] == agg["_parent_key"], "left").drop("_parent_key")


def descend(parent: DataFrame, child: DataFrame, key: str, fk: str) -> DataFrame:
    """INNER join down one level of a hierarchy: parents without children drop out."""
    return parent.join(child, parent[key] == child[fk], "inner")
