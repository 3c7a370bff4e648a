"""From raw documents to token ids: quality, near copies, benchmark leaks, source weights, token files.

Each stage takes (spark, docs, sf_dir), works on all rows the one before it kept, and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outline_jobs.llm import decontamination, factorization, mixing, ngram_join, repair
from outline_jobs.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more."""
    machine = factorization.trained(docs, table(spark, sf_dir, "labels"))
    return factorization.accepted(docs, machine, 0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each document."""
    return repair.encoded(docs, repair.tokenizer_path())


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: The first stage is a trained model, which SQL cannot express. test_pipeline_against_brute_force holds every row of a run: the machine's own scores, the stages' SQL, the library's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
