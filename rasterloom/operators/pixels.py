"""Pixel transforms over the long relation (image_id, i, ch, v).

``i`` is the pixel's place in its image, ``ch`` its channel, ``v`` its value. Images
may be large, so running operators work in blocks of :data:`BLOCK` pixels: windows
stay inside a block, and a small table of block edges or block sums carries across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
_CHANNEL = ["image_id", "ch"]


def split_channels(df: DataFrame, samples: str = "samples") -> DataFrame:
    """image_id, i, ch, v from rows (image_id, i, array of the pixel's samples)."""
    return df.select("image_id", "i", F.posexplode(samples).alias("ch", "v"))


def interleave(df: DataFrame) -> DataFrame:
    """image_id, samples: all values of an image in (i, ch) order.

    Blocks of pixels are ordered where they are; an image then puts its blocks together, without ordering a sample.
    """
    rows = df.groupBy("image_id", F.floor(F.col("i") / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "ch", "v"))).alias("s"))
    blocks = rows.select("image_id", F.struct("b", F.transform("s", lambda x: x["v"]).alias("s")).alias("block"))
    whole = blocks.groupBy("image_id").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    return whole.select("image_id", F.flatten(F.transform("blocks", lambda x: x["s"])).alias("samples"))


def as_bytes(samples: Column, bpp: int = 8) -> Column:
    """BINARY of an array of values, big-endian."""
    digits = bpp // 4
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v.cast("long")), digits, "0")), ""))


def split16(df: DataFrame) -> DataFrame:
    """Each 16-bit sample as high and low byte."""
    return df.select("image_id", "i", "ch", F.shiftright("v", 8).alias("hi"), F.col("v").bitwiseAND(255).alias("lo"))


def merge16(df: DataFrame) -> DataFrame:
    return df.select("image_id", "i", "ch", (F.col("hi") * 256 + F.col("lo")).cast("int").alias("v"))


def palette(df: DataFrame) -> DataFrame:
    """image_id, ch, idx, value: at most 256 values a channel, ascending. Counts combine before the exchange."""
    present = df.groupBy(*_CHANNEL, F.col("v").alias("value")).agg(F.lit(1).alias("one")).drop("one")
    rank = F.row_number().over(Window.partitionBy(*_CHANNEL).orderBy("value")) - 1
    return present.select(*_CHANNEL, rank.cast("int").alias("idx"), "value")


def palette_encode(df: DataFrame, colours: DataFrame) -> DataFrame:
    """image_id, i, ch, idx: the rank of each value in its channel's palette."""
    keys = colours.withColumnRenamed("value", "v")
    return df.join(keys, [*_CHANNEL, "v"]).select("image_id", "i", "ch", "idx")


def palette_apply(df: DataFrame, colours: DataFrame) -> DataFrame:
    """Inverse of :func:`palette_encode`."""
    return df.join(colours, [*_CHANNEL, "idx"]).select("image_id", "i", "ch", F.col("value").alias("v"))


def palette_sizes(colours: DataFrame) -> DataFrame:
    """image_id, palette_bytes, palette_hex: per channel the count less one, then the values."""
    each = colours.groupBy(*_CHANNEL).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("value")).alias("values"))
    two = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    each = each.withColumn("text", F.concat(two(F.col("n") - 1), F.array_join(F.transform("values", two), "")))
    whole = each.groupBy("image_id").agg(F.sum(F.col("n") + 1).alias("palette_bytes"), F.sort_array(F.collect_list(F.struct("ch", "text"))).alias("t"))
    return whole.select("image_id", "palette_bytes", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("palette_hex"))


def _blocked(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))


def delta(df: DataFrame) -> DataFrame:
    """image_id, i, ch, d: each value less the one before it in its channel, modulo 256."""
    rows = _blocked(df)
    last = rows.groupBy(*_CHANNEL, (F.col("block") + 1).alias("block")).agg(F.max_by("v", "i").alias("edge"))
    inside = Window.partitionBy(*_CHANNEL, "block").orderBy("i")
    rows = rows.withColumn("before", F.lag("v").over(inside)).join(last, [*_CHANNEL, "block"], "left")
    return rows.select("image_id", "i", "ch", F.pmod(F.col("v") - F.coalesce("before", "edge", F.lit(0)), F.lit(256)).cast("int").alias("d"))


def prefix_sum(df: DataFrame, value: str = "d") -> DataFrame:
    """image_id, i, ch, v: running sums modulo 256, the inverse of :func:`delta`."""
    rows = _blocked(df)
    sums = rows.groupBy(*_CHANNEL, "block").agg(F.sum(value).alias("s"))
    before = Window.partitionBy(*_CHANNEL).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*_CHANNEL, "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*_CHANNEL, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, [*_CHANNEL, "block"])
    return rows.select("image_id", "i", "ch", F.pmod(F.col("start") + F.sum(value).over(inside), F.lit(256)).cast("int").alias("v"))


def swap_rgb(df: DataFrame) -> DataFrame:
    """Channels 0, 1, 2 in reverse; further ones (alpha) dropped."""
    return df.where("ch < 3").withColumn("ch", (2 - F.col("ch")).cast("int"))


def coordinates(df: DataFrame, width: int) -> DataFrame:
    """df with row y and column x."""
    return df.withColumn("y", F.floor(F.col("i") / width).cast("long")).withColumn("x", F.pmod(F.col("i"), F.lit(width)).cast("long"))


def channel_summary(df: DataFrame) -> DataFrame:
    """image_id, ch, n, n_unique, sum_v."""
    return df.groupBy(*_CHANNEL).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").cast("long").alias("n_unique"), F.sum("v").alias("sum_v"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, same_shape, identical, max_diff, psnr of two relations; null where the shapes differ, psnr also where identical."""
    both = a.select("image_id", "i", "ch", F.col("v").alias("va")).join(b.select("image_id", "i", "ch", F.col("v").alias("vb")), ["image_id", "i", "ch"], "full")
    diff = F.abs(F.col("va") - F.col("vb"))
    found = both.groupBy("image_id").agg(F.count_if(F.col("va").isNull() | F.col("vb").isNull()).alias("odd"), F.max(diff).alias("m"), F.avg((diff * diff).cast("double")).alias("mse"))
    same = F.col("odd") == 0
    return found.select(
        "image_id", same.alias("same_shape"), (same & (F.col("m") == 0)).alias("identical"), F.when(same, F.col("m").cast("int")).alias("max_diff"),
        F.when(same & (F.col("m") > 0), F.round(10 * F.log10(65025 / F.col("mse")), 6)).alias("psnr"),
    )
