"""Operators over collections of files: discovery, pairing, parity, statistics.

A file set is (path, stem, ext, length). Everything is a join, an aggregate or a
top-k; nothing depends on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = (".ppm", ".pnm", ".png", ".jpg", ".jpeg")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for none. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def relative(path: Column, root: str) -> Column:
    """The path below a folder; a path outside it as it stands."""
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(path)


def below(spark: SparkSession, path: Column, folder: str) -> Column:
    """The path that a file scan gives, relative to the folder it was asked for; the name alone where that is a file."""
    jvm = spark.sparkContext._jvm
    asked = jvm.org.apache.hadoop.fs.Path(folder)
    full = asked.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(asked).toString()
    plain = lambda x: re.sub(r"^file:/+", "/", x)
    here = F.regexp_replace(path, r"^file:/+", "/")
    return F.when(here == plain(full), base_name(here)).otherwise(relative(here, plain(full)))


def swap_suffix(path: Column, suffix: str) -> Column:
    """The path with its extension replaced; added where there is none."""
    return F.when(base_name(path).rlike(r"^.+\.[^.]*$"), F.regexp_replace(path, r"\.[^./]*$", suffix)).otherwise(F.concat(path, F.lit(suffix)))


def files(spark: SparkSession, folder: str, *, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """path, stem, ext, length of the files of a folder; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    path = F.regexp_replace("path", r"^file:/*", "/")
    return reader.load(folder).select(path.alias("path"), "length").select("path", stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext"), "length")


def discover(spark: SparkSession, folder: str, extensions=IMAGE_EXTENSIONS, most: int = 0, recursive: bool = False) -> DataFrame:
    """The first ``most`` files (0: all) by path with one of the extensions."""
    found = files(spark, folder, recursive=recursive).where(F.col("ext").isin(*extensions))
    return first(found, "path", most) if most else found.orderBy("path")


def first(df: DataFrame, by: str | Column, most: int) -> DataFrame:
    """Sort and limit; 0 is no limit."""
    rows = df.orderBy(by)
    return rows.limit(most) if most else rows


def pair(a: DataFrame, b: DataFrame, on: str = "stem") -> DataFrame:
    """The rows of ``a`` with a partner in ``b``, and both lengths."""
    return a.join(b.select(on, F.col("path").alias("b_path"), F.col("length").alias("b_length")), on)


def pair_trees(a: DataFrame, a_root: str, b: DataFrame, b_root: str) -> DataFrame:
    """Files of two trees that have the same place in them but for the extension: place, path, b_path and both lengths."""
    placed = lambda df, root: df.withColumn("place", swap_suffix(relative(F.col("path"), root), ""))
    return pair(placed(a, a_root), placed(b, b_root), "place")


def parity(a: DataFrame, b: DataFrame, a_suffix: str, b_suffix: str) -> DataFrame:
    """missing: names that one side has more often than the other, with the suffix they lack."""
    x, y = a.select("stem"), b.select("stem")
    lack = lambda df, suffix: df.select(F.concat("stem", F.lit(suffix)).alias("missing"))
    return lack(x.exceptAll(y), b_suffix).unionAll(lack(y.exceptAll(x), a_suffix))


def sample(df: DataFrame, key: str, k: int, seed: str = "0") -> DataFrame:
    """k rows without replacement, by the hash of a key, the same each time."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(k)


def ratio_stats(ratio: Column) -> list[Column]:
    """mean, min, max and population deviation, 0 where there is nothing."""
    zero = F.lit(0.0)
    parts = {"mean": F.avg(ratio), "min": F.min(ratio), "max": F.max(ratio), "stddev": F.stddev_pop(ratio)}
    return [F.round(F.coalesce(v, zero), 6).alias(f"ratio_{k}") for k, v in parts.items()]


def size_totals(src: Column, dst: Column) -> list[Column]:
    """Total sizes, their ratio (infinite for nothing written) and the saving in per cent."""
    s, d = F.sum(src), F.sum(dst)
    ratio = F.when(d > 0, s / d).otherwise(F.lit(float("inf")))
    return [s.alias("src_bytes"), d.alias("dst_bytes"), F.round(ratio, 6).alias("ratio"), F.round(F.when(s > 0, (1 - d / s) * 100).otherwise(0.0), 6).alias("saving_pct")]


def truncated_ratio(a: Column, b: Column) -> Column:
    """a / b cut, not rounded, to two places; null for a zero b."""
    return F.when(b != 0, F.floor(a * 100 / b) / 100)


def upper_median(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Of each group without its first row: the middle value, the upper one of two.

    Counts of values combine before the exchange, so no task sorts a whole group.
    """
    first_row = F.broadcast(df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min(order).alias("_g_first")))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    rows = df.join(first_row, same).where(F.col(order) > F.col("_g_first"))
    # the lower of two from above is the upper one
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").alias("median"))


def best_of(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Best of each side, the gain in per cent, the winner and the speed-up."""
    x, y = F.min(a), F.min(b)
    rows = df.groupBy(*by).agg(x.alias("best_a"), y.alias("best_b"))
    gain = F.when(F.col("best_a") != 0, (F.col("best_a") - F.col("best_b")) / F.col("best_a") * 100)
    fast, slow = F.least("best_a", "best_b"), F.greatest("best_a", "best_b")
    return rows.select(*by, "best_a", "best_b", (F.round(gain, 6) + F.lit(0.0)).alias("gain_pct"), F.when(F.col("best_b") < F.col("best_a"), "b").otherwise("a").alias("winner"), F.round(F.when(fast != 0, slow / fast), 6).alias("speedup"))


def net_time(t: Column, overhead: Column) -> Column:
    return F.greatest(t - overhead, F.lit(0.0))


def summary_by_label(df: DataFrame) -> DataFrame:
    """Means and whether all were identical, of (label, compress_ms, decompress_ms, ratio, identical)."""
    return df.groupBy("label").agg(
        *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("compress_ms", "decompress_ms", "ratio")], F.bool_and("identical").alias("all_identical")
    )


def fixed(x: Column, places: int) -> Column:
    """Decimal text of a double, rounded from its exact binary value (format_string rounds its shortest decimal)."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def fmt_bytes(n: Column) -> Column:
    """Decimal units: three places for GB, two for MB, one for KB."""
    unit = lambda size, places, name: F.concat(fixed(n / size, places), F.lit(name))
    return F.when(n >= 1_000_000_000, unit(1e9, 3, " GB")).when(n >= 1_000_000, unit(1e6, 2, " MB")).when(n >= 1_000, unit(1e3, 1, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def fmt_ms(t: Column) -> Column:
    """Milliseconds to one place, padded to eight characters."""
    text = fixed(t, 1)
    return F.concat(F.lpad(text, F.greatest(F.length(text), F.lit(8)), F.lit(" ")), F.lit(" ms"))


def pixel_label(identical: Column, max_diff: Column, psnr: Column) -> Column:
    """How two images compare, in words and without colours."""
    apart = F.concat(F.lit("DIFF  max="), F.coalesce(max_diff.cast("string"), F.lit("None")), F.when(psnr.isNotNull(), F.concat(F.lit("  PSNR="), fixed(psnr, 1), F.lit(" dB"))).otherwise(""))
    return F.when(identical, "IDENTICAL").otherwise(apart)


def flag_names(configuration: Column) -> Column:
    """RLE and PALETTE joined by +, or none."""
    names = F.concat_ws("+", F.when(configuration.bitwiseAND(2) != 0, "RLE"), F.when(configuration.bitwiseAND(4) != 0, "PALETTE"))
    return F.when(names == "", "none").otherwise(names)


def mode_flags(mode: Column) -> Column:
    """Configuration bits of a command; null for an unknown one."""
    return F.when(mode == "pack", 1).when(mode == "compress", 3).when(mode == "compress-palette", 7)
