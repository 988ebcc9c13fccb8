"""Corpus pipeline: documents that remain after each stage are written and read again as the next stage's input.

1. ``toxicity`` rejects documents that the classifier predicts to be toxic; it doesn't learn from the held-out third of the labels.
2. ``ngram_jaccard`` keeps one document, the one with the smallest id, of each component of near duplicates.
3. ``decontamination`` rejects documents that hold a benchmark item.
4. ``mixing`` repeats documents at rates that bring their sources to target weights, and shuffles them.
5. ``sharding`` deals what is left into shards; it returns the placement, a row for each copy.

Every stage works with null ids and texts, repeated rows, empty tables and extra columns as its operator does; a row that
shares the id of another document, but not its text, is judged by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox
from tessera.llm.common import Scratch
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_jaccard import one_of_each
from tessera.llm.sharding import shard_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = tox.fit(spark, docs, labels, ~tox.held_out(F.col("id")))
    return tox.score(spark, docs, model).filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an id are in no component and stay. Rows are told apart by id and text: of a component one row stays."""
    return one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(spark, docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can't express the trained classifier, nor the embedding's search; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
