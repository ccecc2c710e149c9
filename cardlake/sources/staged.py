"""Tables that become visible together.

Folders are written under a run of their own and then named in a manifest.  A reader takes
the manifest with the highest number, so it sees all of a run or nothing of it: a load
that fails midway leaves the tables of the one before.  A manifest is written aside and
renamed; its number is taken by the rename itself, so of two runs that end at
once one wins and the other raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, target: str) -> list[int]:
    fs, path = _fs(spark, f"{target.rstrip('/')}/{MANIFEST}")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def read_manifest(spark: SparkSession, target: str) -> tuple[int, dict[str, str]]:
    """(number, folder of each entry) of the newest manifest; (0, {}) if there is none."""
    numbers = _numbers(spark, target)
    if not numbers:
        return 0, {}
    line = spark.read.text(f"{target.rstrip('/')}/{MANIFEST}/{numbers[-1]}", wholetext=True).first()[0]  # one name and folder a table
    return numbers[-1], json.loads(line)


def swap_manifest(spark: SparkSession, target: str, after: int, entries: Mapping[str, str]) -> int:
    """Make ``entries`` visible as the manifest that follows number ``after``."""
    root = f"{target.rstrip('/')}/{MANIFEST}"
    fs, aside = _fs(spark, f"{root}/.{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(json.dumps(dict(entries), sort_keys=True).encode()))
    finally:
        out.close()
    _, final = _fs(spark, f"{root}/{after + 1}")
    if fs.exists(final) or not fs.rename(aside, final):
        raise RuntimeError(f"{target}: manifest {after + 1} was written by another run")
    return after + 1


def load_staged(spark: SparkSession, tables: Mapping[str, DataFrame], target: str, keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Replace all tables of ``target`` at once and report ``(table_name, rows, null_keys)``.

    The counts are observed while the rows are written; nothing is read again.  ``keys`` names
    the columns of a table whose nulls are counted (a row counts once).  If a write
    fails, the error is raised and readers go on seeing the previous load."""
    number, _ = read_manifest(spark, target)
    run = f"runs/{uuid.uuid4().hex}"
    report = []
    for name, df in tables.items():
        seen = Observation()
        missing = F.greatest(F.lit(False), F.lit(False), *(F.col(f"`{k}`").isNull() for k in (keys or {}).get(name, [])))
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("null_keys")).write.parquet(f"{target.rstrip('/')}/{run}/{name}")
        report.append((name, seen.get["rows"], seen.get["null_keys"]))
    swap_manifest(spark, target, number, {name: f"{run}/{name}" for name in tables})
    return spark.createDataFrame(report, "table_name string, rows long, null_keys long")


def read_staged(spark: SparkSession, target: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The visible tables, or those of them that are named."""
    _, entries = read_manifest(spark, target)
    return {n: spark.read.parquet(f"{target.rstrip('/')}/{entries[n]}") for n in (entries if names is None else names)}
