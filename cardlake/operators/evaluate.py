"""Question-set evaluation.

Answers come from a pluggable Python function run in ``mapInPandas`` (each call timed,
a failure becomes the answer text instead of failing the job); the report is one
aggregate per category.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardlake.operators.nest import ordered_list

# Fixed value: prefix of an answer that failed.
FAILED = "ERREUR TECHNIQUE : "

RESULT_SCHEMA = ("category string, category_ord int, pos int, id_question string, question string, "
                 "temps_reponse_secondes double, reponse_ia string")


def evaluate(questions: DataFrame, make_answerer: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``questions``: ``(category, category_ord, pos, id, question)``.  ``make_answerer()``
    runs once per task and returns ``question -> answer``."""
    cols = ["category", "category_ord", "pos", "id", "question"]

    def run(batches):
        answer = make_answerer()
        for pdf in batches:
            out_t, out_a = [], []
            for q in pdf["question"].tolist():
                t0 = time.perf_counter()
                try:
                    a = answer(q)
                except Exception as e:  # the run records the failure and goes on
                    a = f"{FAILED}{e}"
                out_t.append(round(time.perf_counter() - t0, 2))
                out_a.append(a)
            yield pd.DataFrame({
                "category": pdf["category"], "category_ord": pdf["category_ord"].astype("int32"),
                "pos": pdf["pos"].astype("int32"), "id_question": pdf["id"], "question": pdf["question"],
                "temps_reponse_secondes": out_t, "reponse_ia": out_a,
            })

    return questions.select(*cols).mapInPandas(run, RESULT_SCHEMA)


def resume(questions: DataFrame, make_answerer: Callable[[], Callable[[str], str]], log: str, retry_failed: bool = False) -> DataFrame:
    """Answer the questions that the log folder does not hold yet, append the answers and
    return the whole log, one row a question.

    The log is append-only Parquet: a run that breaks off loses nothing of the runs before
    it, and running again answers what is left.  A question is known by category and id.
    Failures are rows like any other; with ``retry_failed`` they are asked again and the
    latest answer of a question counts."""
    spark = questions.sparkSession
    key = [F.col("category"), F.col("id_question")]
    try:
        done = spark.read.parquet(log)
        run = (done.agg(F.max("run")).first()[0] or 0) + 1
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done, run = None, 1
    todo = questions
    if done is not None:
        known = done.where(~F.col("reponse_ia").startswith(FAILED)) if retry_failed else done
        todo = questions.join(known.select("category", F.col("id_question").alias("id")).distinct(), ["category", "id"], "left_anti")
    evaluate(todo, make_answerer).withColumn("run", F.lit(run)).write.mode("append").parquet(log)
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("run"), "pos"))
    return spark.read.parquet(log).withColumn("_nth", latest).where("_nth = 1").drop("_nth")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The nested result files of :func:`write_results` as one row a question."""
    item = "struct<id_question: string, question: string, temps_reponse_secondes: double, reponse_ia: string>"
    raw = spark.read.schema(f"category string, results array<{item}>").json(path)
    return raw.select("category", F.posexplode("results").alias("nth", "r")).select("category", "nth", "r.*")


def latency_report(results: DataFrame, value: str = "temps_reponse_secondes", by: str = "category") -> DataFrame:
    """Count, mean, median, min, max per category, rounded to 2 (E11).  The median is
    exact with bounded memory per category (:func:`cardlake.operators.stats.exact_quantile`)."""
    from cardlake.operators.stats import exact_quantile

    basic = results.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 2).alias("mean"),
        F.round(F.min(value), 2).alias("min"),
        F.round(F.max(value), 2).alias("max"),
    )
    med = exact_quantile(results, [by], value, 0.5, "median")
    return basic.join(med, by, "left").select(by, "n", "mean", F.round("median", 2).alias("median"), "min", "max")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON line per category holding its results in question order."""
    per = results.groupBy("category", "category_ord").agg(ordered_list(
        ["pos"], ["id_question", "question", "temps_reponse_secondes", "reponse_ia"]).alias("results"))
    per.drop("category_ord").write.mode("overwrite").json(path)
