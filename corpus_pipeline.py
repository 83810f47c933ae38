"""A training corpus from raw documents: toxic documents go, then near copies, repeated passages and benchmark text; the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the folder that all executors share and
reads it again as the next stage's ``docs``.  All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilflow.llm import decontamination, near_dedup, sentencepiece_bpe, severity, substrings
from veilflow.llm.scratch import Scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones among ``docs``, holds for toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = severity.fit_severity(severity.labelled_sample(docs, labels))
    return severity.drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles stays, the one with the least id."""
    return near_dedup.drop_near_duplicates(docs, k=5, num=80, den=100)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words or more that stand anywhere else go, wherever they stand."""
    return substrings.remove_repeats(docs, length=50)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark items go; documents that are little else go too."""
    return decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10, drop_share=0.8)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids with begin and end, and a check that they decode to the same text."""
    return sentencepiece_bpe.round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL can express neither the model nor the tokenizer: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
