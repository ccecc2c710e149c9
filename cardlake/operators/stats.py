"""Exact quantiles per group with bounded memory.

``F.median``/``percentile`` keep every distinct value of a group in one aggregation
buffer, so a group holding a third of a very large table would land in one task.  Here
the quantile's one or two target ranks are found by narrowing a value range per group:

1. one partial aggregate gives per group ``n``, ``min`` and ``max``; the targets are the
   0-based ranks ``floor(h)`` and ``ceil(h)`` with ``h = (n - 1) * q``;
2. while a target's range holds more than ``max_exact`` rows, its rows are counted in
   ``buckets`` equal-width buckets of an integer key (a partial aggregate: at most
   ``buckets`` rows per group and target, whatever the group size); the bucket holding the
   target rank becomes the new range, bounded by the actual minimum and maximum in it.
   The key is the value's 64-bit pattern in sortable form, so infinities and values of any
   magnitude are ordinary keys, nothing overflows, and every pass shrinks the range;
3. a range of at most ``max_exact`` rows is collected and sorted, and the target picked.

The result interpolates like ``percentile``/``quantile_cont``:
``x[floor(h)] + (h - floor(h)) * (x[ceil(h)] - x[floor(h)])``.  NULL values are ignored.
NaN is the largest value, as Spark orders it.  The small per-pass state is checkpointed to
the shared folder, and the driver only asks whether any target is still open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardlake.session import cut

STATE_ROW_BYTES = 64  # the fixed-width state columns of one row


def _broadcast_limit(spark: SparkSession) -> int:
    from cardlake.operators.retrieve import _broadcast_limit as limit

    return limit(spark)


def sortable(v: Column) -> Column:
    """Integer key in the order of the doubles: -inf < numbers < inf < NaN; -0.0 is 0.0."""
    plain = F.when(v == 0, F.lit(0.0)).otherwise(v)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits >= 0, bits).when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1).cast("long")))


def from_sortable(key: Column) -> Column:
    """The double of a key."""
    bits = F.when(key >= 0, key).otherwise(key.bitwiseXOR(F.lit((1 << 63) - 1).cast("long")))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _measure(state: DataFrame, keys: Sequence[str], is_open) -> tuple[int, int, int, int]:
    """One pass over the state: rows and approximate bytes of the targets still open
    and of those left to collect."""
    key_bytes = sum((F.coalesce(F.length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    size = key_bytes + STATE_ROW_BYTES
    small = ~is_open & (F.col("_lo") < F.col("_hi"))
    r = state.agg(F.count_if(is_open).alias("no"), F.sum(F.when(is_open, size)).alias("bo"),
                  F.count_if(small).alias("ns"), F.sum(F.when(small, size)).alias("bs")).first()
    return int(r["no"]), int(r["bo"] or 0), int(r["ns"]), int(r["bs"] or 0)


def _with_state(data: DataFrame, state: DataFrame, keys: Sequence[str], state_bytes: int) -> DataFrame:
    """Rows inside their target's current range.  The state is one small row per
    (group, target): broadcast when its measured size allows, otherwise a shuffle join
    on the group (AQE splits a hot group)."""
    side = state
    if state_bytes <= _broadcast_limit(data.sparkSession):
        side = F.broadcast(state)
    j = data.join(side, list(keys))
    return j.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float = 0.5, out: str = "quantile",
                   buckets: int = 4096, max_exact: int = 100_000) -> DataFrame:
    """``(keys..., out)``: the exact ``q`` quantile of ``value`` per group (groups with
    no non-NULL value are absent)."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must lie in [0, 1]")
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, sortable(F.col(value).cast("double")).alias("_v"))
    stats = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"),
                                    F.max("_v").alias("_hi"))
    h = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    targets = F.array_distinct(F.array(F.floor(h).cast("long"), F.ceil(h).cast("long")))
    state = stats.select(*keys, "_n", F.explode(targets).alias("_r"), "_lo", "_hi",
                         F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_cnt"))
    state = cut(state)
    is_open = (F.col("_lo") < F.col("_hi")) & (F.col("_cnt") > max_exact)
    n_open, open_bytes, n_small, small_bytes = _measure(state, keys, is_open)
    while n_open:
        open_ = state.where(is_open)
        rows = _with_state(data, open_, keys, open_bytes)
        # keys are below 2^63 in size, so their span may not fit in 64 bits: decimals
        span = (F.col("_hi").cast("decimal(20,0)") - F.col("_lo").cast("decimal(20,0)") + 1)
        b = F.floor((F.col("_v").cast("decimal(20,0)") - F.col("_lo").cast("decimal(20,0)")) * buckets / span).cast("long")
        counts = rows.groupBy(*keys, "_n", "_r", "_below", b.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi"))
        w = Window.partitionBy(*keys, "_r").orderBy("_b")  # at most `buckets` rows per group and target
        counts = counts.withColumn("_end", F.col("_below") + F.sum("_c").over(w))
        chosen = counts.where((F.col("_end") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_end")))
        narrowed = chosen.select(*keys, "_n", "_r", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
                                 (F.col("_end") - F.col("_c")).alias("_below"), F.col("_c").alias("_cnt"))
        state = cut(state.where(~is_open).unionByName(narrowed))
        n_open, open_bytes, n_small, small_bytes = _measure(state, keys, is_open)
    # every target is now a single value (lo == hi) or a range of at most max_exact rows
    done = state.where(F.col("_lo") == F.col("_hi")).select(*keys, "_n", "_r", F.col("_lo").alias("_x"))
    small = state.where(F.col("_lo") < F.col("_hi"))
    picked = done
    if n_small:
        rows = _with_state(data, small, keys, small_bytes)
        sorted_ = rows.groupBy(*keys, "_n", "_r", "_below").agg(F.sort_array(F.collect_list("_v")).alias("_vals"))
        picked = done.unionByName(sorted_.select(
            *keys, "_n", "_r", F.element_at("_vals", (F.col("_r") - F.col("_below") + 1).cast("int")).alias("_x")))
    per = picked.groupBy(*keys).agg(F.max("_n").alias("_n"), F.min_by("_x", "_r").alias("_xlo"),
                                   F.max_by("_x", "_r").alias("_xhi"))
    frac = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    frac = frac - F.floor(frac)
    lo, hi = from_sortable(F.col("_xlo")), from_sortable(F.col("_xhi"))
    # between equal values (infinities too) nothing is interpolated
    return per.select(*keys, F.when((F.col("_xlo") == F.col("_xhi")) | (frac == 0), lo).otherwise(lo + frac * (hi - lo)).alias(out))
