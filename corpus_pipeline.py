"""The corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.llm import contamination, packing, passages, simhash, toxicity
from siltstream.llm.shared import saved, text_hash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not reject."""
    return toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).accepted(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document that names the group."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; emptied documents go."""
    return passages.cut_out(docs, passages.repeats(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts are named by their hash, for an id may
    stand for several."""
    texts = docs.select(text_hash().alias("doc_id"), "text")
    leaks = contamination.tilings(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = leaks.select(F.col("doc_id").alias("leak")).distinct()
    # The row in one column, so that no name of its own clashes with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_hash().alias("hash"))
    return rows.join(leaks, F.col("hash") == F.col("leak"), "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_copies", one_of_each_group),
    ("repeats", without_repeats),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: The rules of the stages cannot be written in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
