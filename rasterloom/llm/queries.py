"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import embeddings, licenses, mixing, neardup, packing, planes, quality, sharding, toxicity, weaklabel
from rasterloom.llm.sql import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark, _table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, _table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_rows(mixing.mix_plan(spark, _table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read_documents(spark, planes.write_ids(spark, _table(spark, sf_dir, "documents")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weaklabel.score(spark, docs, *weaklabel.fit(spark, docs))


def document_path():
    """Documents have no path of their own: source, language, a folder of 64 ids, the id."""
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"), path=document_path(), keys=("doc_id",))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model).withColumn("toxic", F.col("rejected")).withColumn("kept", ~F.col("rejected"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_embeddings, op2_sharding, op3_mixing, op4_packing, op5_token_planes, op6_quality_rules, op7_minhash, op8_weak_labels, op9_licenses, op10_toxicity)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
