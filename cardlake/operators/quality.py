"""Data-quality suites (K1-K4): not-null, unique and source-declaration checks.

All not-null checks of one table run in a single scan (one ``count_if`` per column,
partial aggregation, one row out), fused into the table's first unique check when it has
one.  A unique check is ``groupBy(col).count()`` with a
map-side partial count, so a hot value costs one row per task before the shuffle; the
result is the number of values seen more than once (NULLs ignored), like a
``unique`` column test that returns offending values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RESULT_SCHEMA = "table_name string, column_name string, test string, failures bigint, status string"


@dataclass(frozen=True)
class Spec:
    table: str
    column: str
    tests: tuple[str, ...]  # subset of ("not_null", "unique")


def _status(failures):
    return F.when(failures == 0, F.lit("pass")).otherwise(F.lit("fail"))


def not_null_checks(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass: NULL count of every listed column, unpivoted to one row per column."""
    if not columns:
        raise ValueError("no columns")
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stacked = counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("failures"))
                            for c in columns])).alias("r")
    ).select("r.*")
    return stacked.select(
        F.lit(name).alias("table_name"), "column_name", F.lit("not_null").alias("test"), "failures",
        _status(F.col("failures")).alias("status"),
    )


def unique_check(name: str, df: DataFrame, column: str) -> DataFrame:
    dup = (
        df.where(F.col(column).isNotNull())
        .groupBy(column).count()
        .where(F.col("count") > 1)
        .agg(F.count(F.lit(1)).cast("bigint").alias("failures"))
    )
    return dup.select(
        F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit("unique").alias("test"),
        "failures", _status(F.col("failures")).alias("status"),
    )


def schema_check(spark: SparkSession, name: str, df: DataFrame | None, expected: Sequence[str]) -> DataFrame:
    """Source declaration (K4): the table exists and has every expected column.
    One row per expected column; failures = 1 when it is missing."""
    present = set(df.columns) if df is not None else set()
    rows = [(name, c, "exists", 0 if c in present else 1, "pass" if c in present else "fail") for c in expected]
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def conformance(name: str, df: DataFrame, declared: StructType) -> DataFrame:
    """Source declaration over data (K4): one row per declared column with the number of
    values that are not of its type, and of rows if the column is missing; extra columns
    come with 0.  All columns are counted in one scan, by ``try_cast`` of their text."""
    present = {c.lower() for c in df.columns}
    wrong, shown = [], []
    for f in declared.fields:
        if f.name.lower() in present:
            text = F.col(f"`{f.name}`").cast("string")
            wrong.append(F.count_if(text.isNotNull() & text.try_cast(f.dataType).isNull()))
            shown.append((f.name, "type"))
        else:
            wrong.append(F.count(F.lit(1)))
            shown.append((f.name, "missing"))
    for c in df.columns:
        if c.lower() not in {f.name.lower() for f in declared.fields}:
            wrong.append(F.lit(0).cast("long"))
            shown.append((c, "extra"))
    counts = df.agg(*(w.alias(f"_{i}") for i, w in enumerate(wrong)))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("test"), F.col(f"_{i}").alias("failures")) for i, (c, t) in enumerate(shown)))
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    status = F.when(F.col("test") == "extra", "extra").otherwise(_status(F.col("failures")))
    return out.select(F.lit(name).alias("table_name"), "column_name", "test", "failures", status.alias("status"))


def fused_checks(name: str, df: DataFrame, key: str, not_null: Sequence[str]) -> DataFrame:
    """``unique(key)`` and ``not_null`` of every listed column in one scan: the
    ``groupBy(key)`` that finds repeated keys also sums each column's NULLs per key
    (partial aggregation before the shuffle), and its NULL-key group is the key's own
    NULL count."""
    others = [c for c in not_null if c != key]
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"),
                                  *[F.count_if(F.col(c).isNull()).alias(f"_nn{i}") for i, c in enumerate(others)])
    is_null_key = F.col(key).isNull()
    tot = per_key.agg(
        F.count_if(~is_null_key & (F.col("_c") > 1)).cast("bigint").alias("_dup"),
        F.coalesce(F.sum(F.when(is_null_key, F.col("_c"))), F.lit(0)).cast("bigint").alias("_nkey"),
        *[F.coalesce(F.sum(f"_nn{i}"), F.lit(0)).cast("bigint").alias(f"_nn{i}") for i in range(len(others))])
    rows = [F.struct(F.lit(key).alias("column_name"), F.lit("unique").alias("test"), F.col("_dup").alias("failures"))]
    if key in not_null:
        rows.append(F.struct(F.lit(key).alias("column_name"), F.lit("not_null").alias("test"),
                             F.col("_nkey").alias("failures")))
    rows += [F.struct(F.lit(c).alias("column_name"), F.lit("not_null").alias("test"), F.col(f"_nn{i}").alias("failures"))
             for i, c in enumerate(others)]
    out = tot.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select(F.lit(name).alias("table_name"), "column_name", "test", "failures",
                      _status(F.col("failures")).alias("status"))


def run_suite(tables: Mapping[str, DataFrame], specs: Sequence[Spec]) -> DataFrame:
    """Run every spec; one result row per (table, column, test).  A table is scanned
    once when it has a unique test (fused with all its not-null tests), plus once per
    further unique column."""
    parts: list[DataFrame] = []
    for name in dict.fromkeys(s.table for s in specs):
        df = tables[name]
        nn = [s.column for s in specs if s.table == name and "not_null" in s.tests]
        uniq = list(dict.fromkeys(s.column for s in specs if s.table == name and "unique" in s.tests))
        if uniq:
            parts.append(fused_checks(name, df, uniq[0], nn))
            parts += [unique_check(name, df, c) for c in uniq[1:]]
        elif nn:
            parts.append(not_null_checks(name, df, nn))
    return reduce(DataFrame.unionByName, parts)


def assert_suite(results: DataFrame) -> None:
    """Stop the build when any test failed (the build runs models, then tests)."""
    failed = results.where(F.col("status") == "fail").collect()  # as many as there are specs, at most
    if failed:
        detail = ", ".join(f"{r.table_name}.{r.column_name}:{r.test}={r.failures}" for r in failed)
        raise AssertionError(f"data-quality tests failed: {detail}")
