"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash: one exchange whose partition ids are the bucket ids. Pass two puts
the records of a bucket in a canonical order, applies Spark's ``shuffle``, which is a
Fisher-Yates shuffle seeded by the seed and the partition, that is by the bucket, and
writes them. The written buckets, one behind the other, are the shuffled order; their
counts give each its start, so a record knows its place without any global sort, and
nothing is evaluated twice. Shards are equal runs of that order (law ``rows``: at most
one record apart), so a bucket's records go to one shard or two neighbours.

The hash covers the id, the digest and the record's place in the input, so records
that repeat, or share one id, scatter as evenly as others. A retried task reads the
same input in the same order and so gives the same records; the same rows in another
layout of files come out in another order.

Defined results: a null text has size 1 (the one byte for its end) and the CRC of no
bytes; null and repeated ids are records like others; a very long text makes a large
bucket and is never cut; an empty table gives no rows; columns that are not carried
are not read, and those that are must have an order (no maps).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.prefix import starts
from rasterloom.session import bound_batches, stored

SHARDS = 16
SEED = 20_240_607
#: Records of a bucket, and bytes of its texts: both stay well inside a task's memory.
BUCKET_ROWS = 16_384
BUCKET_BYTES = 16 << 20
#: Beyond this many buckets their starts are joined, not broadcast (16 bytes each).
BROADCAST_BUCKETS = 1_000_000


def deal(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, at, record (the id, the text and the carried columns) in shuffled order: the buckets as written, a stored table."""
    bound_batches(spark)
    columns = list(dict.fromkeys([id_col, text_col, *(docs.columns if carry is None else carry)]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_rows, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()
    buckets = max(1, math.ceil(n_rows / bucket_rows), math.ceil(n_bytes / bucket_bytes))
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.octet_length(text), F.crc32(text.cast("binary")), F.monotonically_increasing_id())
    rows = docs.select(mark.alias("mark"), F.struct(*columns).alias("record")).withColumn("bucket", F.pmod("mark", F.lit(buckets)).cast("int"))
    dealt = rows.repartitionById(buckets, F.col("bucket"))
    shuffled = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("mark", "record"))).alias("r")).select("bucket", F.shuffle("r", seed).alias("r"))
    return stored(spark, shuffled.select("bucket", F.posexplode("r").alias("at", "r")).select("bucket", "at", "r.record"), "buckets")


def placed(spark: SparkSession, dealt: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of :func:`deal` with shard and slot."""
    counts = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = dealt.count()
    first = starts(counts, "bucket", "n").select(F.col("bucket").alias("s_bucket"), F.col("start").alias("first"))
    if counts.count() <= BROADCAST_BUCKETS:
        first = F.broadcast(first)
    out = dealt.join(first, F.col("bucket") == F.col("s_bucket"))
    place = F.col("first") + F.col("at")
    out = out.withColumn("shard", F.expr(f"(first + at) * {shards} div {max(1, total)}").cast("int"))
    begin = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return out.select("record", "shard", (place - begin).cast("long").alias("slot"))


def shard(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each record, from the written buckets."""
    rows = placed(spark, deal(spark, docs, id_col=id_col, text_col=text_col, **({"carry": ()} | options)), shards)
    text = F.coalesce(F.col("record").getField(text_col).cast("string"), F.lit(""))
    return rows.select(
        F.col("record").getField(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, *, shards: int = SHARDS, **options) -> None:
    """Write the shuffled shards with all columns of ``docs``: one folder ``shard=k`` each, in slot order inside a file."""
    out = placed(spark, deal(spark, docs, **options), shards)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
