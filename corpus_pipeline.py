"""A training-data pipeline over the table documents: five stages, each of them one operator over all rows it gets.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.

1. toxicity: rows whose score reaches the threshold go.
2. near_dedup: of each group of near duplicates (five words, similarity 0.8) the row of the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets in text are replaced by [SECRET]; n_chars follows. No row goes.
5. mixing: every row gets the rate at which its language's expected tokens come to an equal share.

Null and empty texts pass every stage; a row with a null doc_id can't be a duplicate and stays. An empty table
gives an empty result. Other columns of documents are carried along.

A doc_id can stand in several rows. Every stage decides by row, by a row's own text: rows of one doc_id with different texts
are different documents. Of rows that repeat doc_id and text one stays in near_dedup. Only labels belong to a doc_id: each of
its rows is learned from with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillcount.llm import decontaminate, mixing, near_dedup, secrets, toxicity
from quillcount.llm.staging import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def with_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, "lang")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("mixing", with_rates),
]

#: Classifiers, sketches and fitted rates aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
