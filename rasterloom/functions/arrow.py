"""Kernels as Arrow stages over DataFrames, and as SQL functions.

Rows of an image may be large, so a stage yields its output in slices of a bounded
number of bytes. Errors are data: a row that fails has a reason and no pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions import container, kernels, pnm
from rasterloom.session import ship

#: Bytes of output that a stage gathers before it passes them on; rows and bytes of input that a kernel gets at once.
SLICE_BYTES = 16 << 20
AT_ONCE, AT_ONCE_BYTES = 1024, 2 << 20
META = ("width", "height", "bpp", "channels", "bpp_internal", "ch_internal", "configuration")
META_SCHEMA = "width long, height long, bpp int, channels int, bpp_internal int, ch_internal int, configuration int"


def _stage(df: DataFrame, keys: list[str], inputs: list[str], outputs: str, one: Callable | None = None, many: Callable | None = None, weigh: Callable | None = None) -> DataFrame:
    """mapInArrow that applies ``one(values of a row) -> tuple of outputs``, or ``many`` to a list of rows, and carries ``keys``.

    weigh: the bytes that a row's values become in ``many``; their own without it.
    """
    import pyarrow as pa

    ship(df.sparkSession)
    schema = df.select(*keys).schema
    for f in T.StructType.fromDDL(outputs):
        schema = schema.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in inputs]
            done: list[tuple] = []
            first = size = 0

            def flush(end: int) -> pa.RecordBatch:
                made = [pa.array(x, arrow.field(len(keys) + i).type) for i, x in enumerate(zip(*done, strict=True))]
                return pa.RecordBatch.from_arrays([batch.column(c).slice(first, end - first).cast(arrow.field(c).type) for c in keys] + made, schema=arrow)

            taken, heavy = [], 0
            for row in range(batch.num_rows):
                taken.append([c[row].as_py() for c in columns])
                heavy += weigh(*taken[-1]) if weigh else sum(len(x) for x in taken[-1] if isinstance(x, bytes))
                if len(taken) < (AT_ONCE if many else 1) and heavy < AT_ONCE_BYTES and row + 1 < batch.num_rows:
                    continue
                done += many(taken) if many else [one(*x) for x in taken]
                size += sum(len(x) for made in done[-len(taken) :] for x in made if isinstance(x, bytes))
                taken, heavy = [], 0
                if size >= SLICE_BYTES:
                    yield flush(row + 1)
                    done, first, size = [], row + 1, 0
            if done:
                yield flush(batch.num_rows)

    return df.select(*dict.fromkeys([*keys, *inputs])).mapInArrow(run, schema)


def _encode_rows(rows):
    images = [(bytes(p or b""), w or 0, h or 0, bpp or 0, c or 0, flags or container.USE_COMPRESSION) for p, w, h, bpp, c, flags in rows]
    return [(None, str(x)) if isinstance(x, ValueError) else (x, None) for x in container.encode_many(images)]


def encode_images(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content, error from width, height, bpp, channels, configuration, pixels."""
    return _stage(df, keys, ["pixels", "width", "height", "bpp", "channels", "configuration"], "content binary, error string", many=_encode_rows)


def _decode_rows(rows):
    return [(None,) * 8 + (x.reason,) if isinstance(x, container.Damaged) else (*x, None) for x in container.decode_many([c for (c,) in rows])]


def decode_images(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, the seven metadata columns, pixels, reason (null where the container is sound)."""
    return _stage(df, keys, [content], f"{META_SCHEMA}, pixels binary, reason string", many=_decode_rows, weigh=container.weight)


def map_images(df: DataFrame, keys: list[str], function: Callable, outputs: str, content: str = "content") -> DataFrame:
    """keys, what ``function(image) -> tuple`` makes of each decoded image, reason: only that leaves the worker, not the pixels."""
    n = len(T.StructType.fromDDL(outputs))

    def rows(taken):
        return [(None,) * n + (x.reason,) if isinstance(x, container.Damaged) else (*function(x), None) for x in container.decode_many([c for (c,) in taken])]

    return _stage(df, keys, [content], f"{outputs}, reason string", many=rows, weigh=container.weight)


def _info_rows(rows):
    return [(None,) * 7 + (x.reason,) if isinstance(x, container.Damaged) else (*x[:7], None) for x in container.decode_many([c for (c,) in rows], pixels=False)]


def _peek_row(content):
    try:
        h = container.peek(content)
    except container.Damaged as e:
        return (None,) * 7 + (e.reason,)
    return h["width"], h["height"], h["bpp_ext"], h["channels_ext"], h["bpp_int"], h["channels_int"], h["config"], None


def info_images(df: DataFrame, keys: list[str], content: str = "content", verify: bool = True) -> DataFrame:
    """keys, the seven metadata columns, reason. verify=False decompresses no more than the header of each container."""
    outputs = f"{META_SCHEMA}, reason string"
    return _stage(df, keys, [content], outputs, many=_info_rows, weigh=container.weight) if verify else _stage(df, keys, [content], outputs, _peek_row)


def _header_row(content):
    try:
        return tuple(container.header_of(container.payload(content)).values())
    except container.Damaged:
        return (None,) * 10


def headers(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys and the ten header words."""
    return _stage(df, keys, [content], ", ".join(f"{f} long" for f in container.HEADER_FIELDS), _header_row)


def _pnm_row(content):
    try:
        return (*pnm.parse(content), None)
    except pnm.BadPnm as e:
        return (None,) * 6 + (e.reason,)


def parse_pnm(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, width, height, bpp, channels, timestamp, pixels, reason."""
    return _stage(df, keys, [content], "width long, height long, bpp int, channels int, timestamp long, pixels binary, reason string", _pnm_row)


def _pnm_bytes(pixels, width, height, bpp, channels):
    try:
        return pnm.write(pixels or b"", width or 0, height or 0, bpp or 0, channels or 0), None
    except ValueError as e:
        return None, str(e)


def write_pnm(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content, error."""
    return _stage(df, keys, ["pixels", "width", "height", "bpp", "channels"], "content binary, error string", _pnm_bytes)


def _picture_row(width, height, channels, data):
    if data is None or channels not in (1, 3, 4) or len(data) != width * height * channels or not data:
        return None, None, None, None, None, "picture"
    samples = np.frombuffer(data, np.uint8).reshape(-1, channels)
    if channels > 1:
        samples = samples[:, 2::-1]
    return width, height, 8, min(channels, 3), samples.tobytes(), None


def from_pictures(df: DataFrame) -> DataFrame:
    """path, width, height, bpp, channels, pixels, reason from rows of the image source: origin, width, height, nChannels, data (blue first)."""
    rows = df.withColumnRenamed("origin", "path")
    return _stage(rows, ["path"], ["width", "height", "nChannels", "data"], "width long, height long, bpp int, channels int, pixels binary, reason string", _picture_row)


def register(spark: SparkSession) -> None:
    """SQL functions: rl_encode, rl_decode, rl_info, rl_checksum, and the table function rl_pixels."""
    ship(spark)
    for name, f in (("rl_encode", rl_encode), ("rl_decode", rl_decode), ("rl_info", rl_info), ("rl_checksum", rl_checksum)):
        spark.udf.register(name, f)
    spark.udtf.register("rl_pixels", rl_pixels)


def _checksums(raw: pd.Series) -> pd.Series:
    out, known = pd.Series([None] * len(raw), dtype="Int64"), np.flatnonzero(raw.notna().to_numpy())
    size = np.cumsum([len(raw.iat[i]) for i in known])
    for part in np.split(known, np.flatnonzero(np.diff(size // AT_ONCE_BYTES)) + 1) if len(known) else []:
        out.iloc[part] = kernels.checksums([bytes(raw.iat[i]) for i in part])
    return out


def _encoded(pixels: pd.Series, width: pd.Series, height: pd.Series, bpp: pd.Series, channels: pd.Series, configuration: pd.Series) -> pd.Series:
    rows = [(None if p is None else bytes(p), *map(int, r)) for p, *r in zip(pixels, width, height, bpp, channels, configuration, strict=True)]
    return pd.Series([content for content, _ in _encode_rows(rows)], dtype=object)


def _decoded(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_decode_rows([(None if c is None else bytes(c),) for c in content]), columns=[*META, "pixels", "reason"])


def _informed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_info_rows([(None if c is None else bytes(c),) for c in content]), columns=[*META, "reason"])


# types as objects: text would need a running session at import
_META = [T.StructField(n, T.LongType() if n in ("width", "height") else T.IntegerType()) for n in META]
_REASON = T.StructField("reason", T.StringType())
rl_checksum = F.pandas_udf(_checksums, T.LongType())
rl_encode = F.pandas_udf(_encoded, T.BinaryType())
rl_decode = F.pandas_udf(_decoded, T.StructType([*_META, T.StructField("pixels", T.BinaryType()), _REASON]))
rl_info = F.pandas_udf(_informed, T.StructType([*_META, _REASON]))


@F.udtf(returnType=T.StructType([T.StructField("i", T.LongType()), T.StructField("ch", T.IntegerType()), T.StructField("v", T.IntegerType())]))
class rl_pixels:  # noqa: N801
    """One row for each sample of a container's image: rl_pixels(content)."""

    def eval(self, content):
        try:
            image = container.decode(bytes(content) if content is not None else None)
        except container.Damaged:
            return
        raw, c = image.pixels, image.channels
        wide = image.bpp == 16
        for k in range(image.width * image.height * c):
            yield k // c, k % c, int.from_bytes(raw[2 * k : 2 * k + 2], "big") if wide else raw[k]


def checksum_sql(raw: Column) -> Column:
    """The checksum as an expression over a BINARY column, for small values and for proof."""
    byte = lambda i: F.conv(F.substring(F.hex(raw), 2 * i + 1, 2), 16, 10).cast("long")
    n = F.length(raw)
    mask = F.lit(0xFFFFFFFF)

    def lane(k: int) -> Column:
        steps = F.when(n > k, F.sequence(F.lit(k), n - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(kernels.LANE_START[k]).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * kernels.LANE_FACTOR[k]).bitwiseAND(mask))

    h = [lane(k) for k in range(4)]
    left = h[0].bitwiseXOR(F.shiftright(h[1], 3))
    right = h[2].bitwiseXOR(F.shiftleft(h[3], 5).bitwiseAND(mask))
    return (left + right).bitwiseAND(mask)
