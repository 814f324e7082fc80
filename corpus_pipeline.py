"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's ``docs``. All but the last return the columns of
``docs`` unchanged; what a stage decides is which rows are there. Stages that filter
texts return no more partitions than their texts need, so that small inputs of many
files do not stay that way. Each begins by having the executors return the heap that
the one before made them take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import mixing, neardup, packing, quality, toxicity
from rasterloom.session import few_files, give_back, stored

#: Texts of a partition, where there are as many.
TEXTS = 2048


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    give_back(spark)
    return few_files(toxicity.reject(spark, docs, toxicity.train(spark, docs, _labels(spark, sf_dir))), docs.count(), TEXTS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    give_back(spark)
    return few_files(quality.keep_good(spark, docs, _labels(spark, sf_dir)), docs.count(), TEXTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: shingles of five words, similarity 0.8."""
    give_back(spark)
    return few_files(neardup.keep_one(spark, docs), docs.count(), TEXTS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix makes over a document; a table keeps no order, so none is made."""
    give_back(spark)
    return few_files(mixing.mix(spark, docs), docs.count(), TEXTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    give_back(spark)
    return packing.pack(spark, docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: Shuffles by seeded hashes, sketches and a trained model have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
