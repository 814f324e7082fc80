"""Rasters made from the driver's tables: the same pixels in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators import pixels as px

PART_WIDTH = 50
LABEL_EXT = ".rlc"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id 0, i, samples: three channels a pixel."""
    p = table(spark, sf_dir, "part")
    byte = lambda c: c.cast("long").bitwiseAND(255).cast("int")
    samples = F.array(byte(F.col("p_size")), byte(F.floor("p_retailprice")), byte(F.length("p_name")))
    return p.select(F.lit(0).cast("long").alias("image_id"), F.col("p_partkey").alias("i"), samples.alias("samples"))


def part_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.split_channels(part_samples(spark, sf_dir))


def event_pixels(spark: SparkSession, sf_dir: str, bits: int = 8) -> DataFrame:
    """One image for each event type, one channel, in order of the event id."""
    e = table(spark, sf_dir, "events")
    v = F.floor("value").cast("long").bitwiseAND(255) if bits == 8 else F.floor(F.col("value") * 100).cast("long").bitwiseAND(65535)
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    return e.select(F.col("event_type").alias("image_id"), i.cast("long").alias("i"), F.lit(0).alias("ch"), v.cast("int").alias("v"))


def embedding_value(e: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5).cast("int")))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    return v.select("image_id", F.col("i").cast("long").alias("i"), F.lit(0).alias("ch"), embedding_value(F.col("e")).alias("v"))


def embedding_images(spark: SparkSession, sf_dir: str, configuration: int = 3) -> DataFrame:
    raw = px.as_bytes(F.transform("embedding", embedding_value))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.size("embedding").cast("long").alias("width"), F.lit(1).cast("long").alias("height"), F.lit(8).alias("bpp"), F.lit(1).alias("channels"),
        F.lit(configuration).alias("configuration"), raw.alias("pixels"),
    )


def images(pixels: DataFrame, *, width: int | None, channels: int, bpp: int, configuration: int) -> DataFrame:
    """Image rows from a pixel relation; a width of None makes a single row of pixels."""
    whole = px.interleave(pixels)
    n = F.floor(F.size("samples") / channels).cast("long")
    return whole.select(
        "image_id", (F.lit(width).cast("long") if width else n).alias("width"), (F.floor(n / width).cast("long") if width else F.lit(1).cast("long")).alias("height"), F.lit(bpp).alias("bpp"), F.lit(channels).alias("channels"),
        F.lit(configuration).alias("configuration"), px.as_bytes(F.col("samples"), bpp).alias("pixels"),
    )


def part_images(spark: SparkSession, sf_dir: str, configuration: int) -> DataFrame:
    return images(part_pixels(spark, sf_dir), width=PART_WIDTH, channels=3, bpp=8, configuration=configuration)


def event_images(spark: SparkSession, sf_dir: str, configuration: int, bits: int = 8) -> DataFrame:
    return images(event_pixels(spark, sf_dir, bits), width=None, channels=1, bpp=bits, configuration=configuration)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: its size is that of the text."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("src/"), key, F.lit(".png")).alias("path"), key.alias("stem"), F.lit(".png").alias("ext"), F.octet_length("text").cast("long").alias("length"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the labelled documents alone, as if they had been encoded to half their size."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    key = F.col("doc_id").cast("string")
    return d.select(F.concat(F.lit("dst/"), key, F.lit(LABEL_EXT)).alias("path"), key.alias("stem"), F.lit(LABEL_EXT).alias("ext"), (F.floor(F.octet_length("text") / 2) + 1).cast("long").alias("length"))


# The same in DuckDB.
PART = """px AS (
  SELECT 0::BIGINT AS image_id, p_partkey::BIGINT AS i, 0 AS ch, (p_size & 255)::INT AS v FROM part
  UNION ALL SELECT 0, p_partkey, 1, (floor(p_retailprice)::BIGINT & 255)::INT FROM part
  UNION ALL SELECT 0, p_partkey, 2, (length(p_name) & 255)::INT FROM part
)"""
EV8 = """px AS (
  SELECT event_type AS image_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, 0 AS ch, (floor(value)::BIGINT & 255)::INT AS v FROM events
)"""
EV16 = """px AS (
  SELECT event_type AS image_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, 0 AS ch, (floor(value * 100)::BIGINT & 65535)::INT AS v FROM events
)"""
EMB = """px AS (
  SELECT vec_id AS image_id, (k - 1)::BIGINT AS i, 0 AS ch, greatest(0, least(255, floor((embedding[k]::DOUBLE + 1) * 127.5)::INT)) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)
)"""
FILES = """src AS (
  SELECT 'src/' || doc_id || '.png' AS path, doc_id::VARCHAR AS stem, '.png' AS ext, octet_length(encode(text))::BIGINT AS length FROM documents
), dst AS (
  SELECT 'dst/' || doc_id || '.rlc' AS path, doc_id::VARCHAR AS stem, '.rlc' AS ext, (octet_length(encode(text)) // 2 + 1)::BIGINT AS length
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
)"""
