"""Session and table helpers.

Everything in the library takes and returns DataFrames; this module only builds a
session for local runs and tests and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(cpus: int | str = "*", app: str = "cardlake", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench. On a cluster the session comes from the
    launcher and none of these settings are forced."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # checkpoint files no longer referenced are removed by the context cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and staged tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local session may do without,
    and gets a scratch folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cardlake-ckpt-", dir=os.environ.get("CARDLAKE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint into the shared checkpoint folder, making
    sure the session's context knows that folder first (a session built elsewhere may
    not have set it)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Expose the driver tables as temp views for SQL use."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
