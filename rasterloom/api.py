"""read, info and write: the three calls of the container's Python surface, on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import arrow, container
from rasterloom.functions.container import USE_COMPRESSION, USE_DELTA, USE_PALETTE
from rasterloom.operators import collection as co
from rasterloom.sources.files import EXTENSION

USE_RLE = USE_DELTA
__all__ = ["USE_COMPRESSION", "USE_PALETTE", "USE_RLE", "encode_tree", "flags", "from_array", "info", "map_arrays", "pictures", "read", "to_array", "write"]


def _files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(path)


def read(spark: SparkSession, path: str, *, extension: str = EXTENSION, strict: bool = False) -> DataFrame:
    """path, the metadata, pixels, reason of each container under ``path``.

    strict: a damaged container ends the query with an error instead of a row that has a reason.
    """
    out = arrow.decode_images(_files(spark, path, extension).select("path", "content"), ["path"])
    return _strict(out) if strict else out


def map_arrays(spark: SparkSession, path: str, function, outputs: str, *, extension: str = EXTENSION) -> DataFrame:
    """path, what ``function(array) -> tuple`` makes of each image, reason: images are loaded on the workers and stay there."""
    return arrow.map_images(_files(spark, path, extension).select("path", "content"), ["path"], lambda image: function(to_array(image._asdict())), outputs)


def info(spark: SparkSession, path: str, *, extension: str = EXTENSION, verify: bool = True, direct: bool = False, strict: bool = False) -> DataFrame:
    """path, the seven metadata columns, reason. verify=False decompresses headers only.

    direct: with verify=False the workers open the files themselves and read no more
    than the header needs; the store must be one that pyarrow reaches.
    """
    if direct and not verify:
        from rasterloom.sources.files import register

        register(spark)
        out = spark.read.format("rasterloom").options(mode="meta", verify="false", extension=extension).load(path)
    else:
        out = arrow.info_images(_files(spark, path, extension).select("path", "content"), ["path"], verify=verify)
    return _strict(out) if strict else out


def pictures(spark: SparkSession, path: str, *, glob: str = "*.{png,jpg,jpeg,bmp,gif}") -> DataFrame:
    """path, width, height, bpp, channels, pixels, reason of PNG, JPEG and other pictures that Spark's image source decodes.

    Samples have 8 bits; colours come as red, green, blue, and an alpha channel is dropped.
    """
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("dropInvalid", "false")
    images = reader.load(path).select("image.origin", *[F.col(f"image.{c}").cast("long").alias(c) for c in ("width", "height", "nChannels")], "image.data")
    return arrow.from_pictures(images)


def encode_tree(spark: SparkSession, source: str, target: str, *, pictures_too: bool = True, use_rle: bool = False, use_palette: bool = False, overwrite: bool = False) -> DataFrame:
    """Encode every anymap and picture below ``source`` to the same place below ``target``: path, reason of those that failed."""
    images = arrow.parse_pnm(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.p[gpn]m").load(source).select("path", "content"), ["path"]).drop("timestamp")
    if pictures_too:
        images = images.unionByName(pictures(spark, source))
    images = images.persist()
    place = co.swap_suffix(co.below(spark, F.col("path"), source), "." + EXTENSION)
    write(images.where("reason is null").withColumn("path", place), target, use_rle=use_rle, use_palette=use_palette, overwrite=overwrite)
    return images.where("reason is not null").select("path", "reason")


def _strict(df: DataFrame) -> DataFrame:
    return df.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "reason"))).otherwise(F.lit(None).cast("string")))


def flags(configuration: int = 0, use_rle: bool = False, use_palette: bool = False) -> int:
    """The configuration word: compression always, the two filters as asked, other bits as given."""
    return configuration | USE_COMPRESSION | (USE_RLE if use_rle else 0) | (USE_PALETTE if use_palette else 0)


def write(df: DataFrame, path: str, *, use_rle: bool = False, use_palette: bool = False, configuration: int = 0, overwrite: bool = False) -> None:
    """Write each row (path, width, height, bpp, channels, pixels) as a container file below ``path``; overwrite: of what was there nothing else stays."""
    from rasterloom.sources.files import register

    register(df.sparkSession)
    cols = ["path", "width", "height", "bpp", "channels", "pixels"]
    rows = df.select(*cols, F.lit(flags(configuration, use_rle, use_palette)).cast("int").alias("configuration"))
    rows.write.format("rasterloom").mode("overwrite" if overwrite else "append").save(path)


def from_array(image: np.ndarray) -> dict:
    """width, height, bpp, channels, pixels of an array (H, W) or (H, W, C) of uint8 or uint16."""
    if image.ndim not in (2, 3):
        raise ValueError(f"an image has 2 or 3 dimensions, not {image.ndim}")
    if image.dtype == np.uint8:
        bpp, raw = 8, image.tobytes()
    elif image.dtype == np.uint16:
        bpp, raw = 16, image.astype(">u2").tobytes()
    else:
        raise ValueError(f"samples are uint8 or uint16, not {image.dtype}")
    h, w = image.shape[:2]
    return {"width": w, "height": h, "bpp": bpp, "channels": image.shape[2] if image.ndim == 3 else 1, "pixels": raw}


def to_array(row) -> np.ndarray:
    """The array of a row of :func:`read`: (H, W, C), or (H, W) for one channel."""
    if row["bpp"] not in (8, 16):
        raise ValueError(f"bpp must be 8 or 16, not {row['bpp']}")
    flat = np.frombuffer(row["pixels"], np.uint8 if row["bpp"] == 8 else ">u2").astype(np.uint8 if row["bpp"] == 8 else np.uint16)
    shape = (row["height"], row["width"], row["channels"])
    return flat.reshape(shape[:2] if row["channels"] == 1 else shape)


encode, decode = container.encode, container.decode
