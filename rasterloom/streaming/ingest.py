"""Continuous encoding: anymap files that arrive in a folder become container files.

A file stream over ``binaryFile`` keeps its own checkpoint, so a restarted query
neither skips nor repeats a file; a batch that is retried writes its files under the
same names. With ``available_now`` the query handles what is there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom import api
from rasterloom.functions import arrow
from rasterloom.operators import collection as co
from rasterloom.sources.files import EXTENSION

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*.p[gpn]m", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (path, content) of the files in a folder and of those that come."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("path", "content")


def encode_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, use_rle: bool = False, use_palette: bool = False, available_now: bool = False) -> StreamingQuery:
    """Encode each arriving anymap to the same place below ``target``, with the extension of containers.

    Files that cannot be read go to ``target/_errors`` as rows (path, reason).
    """
    place = co.swap_suffix(co.below(spark, F.col("path"), source), "." + EXTENSION)

    def batch(files: DataFrame, number: int) -> None:
        images = arrow.parse_pnm(files, ["path"]).persist()
        try:
            good = images.where("reason is null").withColumn("path", place)
            api.write(good, target, use_rle=use_rle, use_palette=use_palette)
            images.where("reason is not null").select("path", "reason").write.mode("overwrite").json(f"{target}/_errors/{number}")
        finally:
            images.unpersist()

    writer = arriving(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
