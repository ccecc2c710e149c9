"""Corpus cleaning pipeline over ``documents``; each stage applies one operator of
``cardlake.llm`` to all that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm import bpe, decontam, linededup, quality, simhash
from cardlake.session import checkpoint_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, does not reject."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.add_scores(docs, weights, score_col="quality_score").where("quality_score >= 0.5").drop("quality_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are on over 2 % of their source's pages, where near
    copies count once: the next stage needs them whole to keep one."""
    return linededup.drop_boilerplate(docs, "source", "text", ratio=0.02, min_pages=3, near=0.8).withColumn(
        "n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (4-word shingles, 4 bits): the smallest doc_id."""
    return simhash.keep_one(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian unsigned 32-bit) and number of tokens.
    The ids are decoded again; a document that they do not give back fails the stage."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    same = F.col("decoded_text") == F.coalesce("text", F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("token ids do not decode back: document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    n = (F.octet_length("token_ids") / 4).cast("long")
    return out.withColumn("n_tokens", F.when(same, n).otherwise(wrong.cast("long"))).drop("decoded_text")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: the classifier and the tokenizer have no SQL form
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
