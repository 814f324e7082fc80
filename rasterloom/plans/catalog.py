"""The queries over the driver's tables, each over its whole table, with their SQL."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import arrow, container
from rasterloom.operators import collection as co
from rasterloom.operators import pixels as px
from rasterloom.plans import fixtures as fx
from rasterloom.session import shared_dir, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# Pixel transforms


@query(f"""WITH {fx.PART}, pal AS (
  SELECT image_id, ch, v, row_number() OVER (PARTITION BY image_id, ch ORDER BY v) - 1 AS idx FROM (SELECT DISTINCT image_id, ch, v FROM px)
), enc AS (SELECT px.image_id, px.i, px.ch, px.v, idx FROM px JOIN pal USING (image_id, ch, v)),
d AS (SELECT *, (idx - coalesce(lag(idx) OVER (PARTITION BY image_id, ch ORDER BY i), 0) + 256) % 256 AS d FROM enc)
SELECT ch, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_unique, sum(v)::BIGINT AS sum_v, sum(d)::BIGINT AS sum_delta, 0::BIGINT AS mismatches FROM d GROUP BY ch""")
def flagship(spark, sf_dir):
    """Palette, delta, prefix sum, palette lookup over a three-channel raster, and what came back."""
    rows = fx.part_pixels(spark, sf_dir)
    colours = px.palette(rows)
    ranks = px.palette_encode(rows, colours)
    deltas = px.delta(ranks.withColumnRenamed("idx", "v"))
    back = px.palette_apply(px.prefix_sum(deltas).withColumnRenamed("v", "idx"), colours)
    key = ["image_id", "i", "ch"]
    both = rows.join(deltas, key).join(back.withColumnRenamed("v", "again"), key)
    return both.groupBy("ch").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("n_unique"), F.sum("v").alias("sum_v"), F.sum("d").alias("sum_delta"), F.count_if(F.col("v") != F.col("again")).alias("mismatches")
    )


@query(f"WITH {fx.PART} SELECT i, ch, v FROM px")
def split_channels(spark, sf_dir):
    return fx.part_pixels(spark, sf_dir).select("i", "ch", "v")


@query(f"WITH {fx.PART} SELECT image_id, count(*)::BIGINT AS n, md5(string_agg(v::VARCHAR, ',' ORDER BY i, ch)) AS digest FROM px GROUP BY image_id")
def interleave(spark, sf_dir):
    whole = px.interleave(fx.part_pixels(spark, sf_dir))
    return whole.select("image_id", F.size("samples").cast("long").alias("n"), F.md5(F.array_join(F.transform("samples", lambda v: v.cast("string")), ",")).alias("digest"))


@query(f"WITH {fx.EV16} SELECT image_id, i, (v >> 8)::INT AS hi, (v & 255)::INT AS lo FROM px")
def split16(spark, sf_dir):
    return px.split16(fx.event_pixels(spark, sf_dir, 16)).select("image_id", "i", "hi", "lo")


@query(f"WITH {fx.EV16} SELECT image_id, i, v FROM px")
def merge16(spark, sf_dir):
    return px.merge16(px.split16(fx.event_pixels(spark, sf_dir, 16))).select("image_id", "i", "v")


_PAL = "SELECT image_id, ch, (row_number() OVER (PARTITION BY image_id, ch ORDER BY v) - 1)::INT AS idx, v AS value FROM (SELECT DISTINCT image_id, ch, v FROM px)"


@query(f"WITH {fx.PART} {_PAL}")
def palette_build(spark, sf_dir):
    return px.palette(fx.part_pixels(spark, sf_dir))


@query(f"WITH {fx.EV8} {_PAL}")
def palette_build_events(spark, sf_dir):
    return px.palette(fx.event_pixels(spark, sf_dir))


@query(f"WITH {fx.PART} SELECT i, ch, (dense_rank() OVER (PARTITION BY image_id, ch ORDER BY v) - 1)::INT AS idx FROM px")
def palette_encode(spark, sf_dir):
    rows = fx.part_pixels(spark, sf_dir)
    return px.palette_encode(rows, px.palette(rows)).select("i", "ch", "idx")


@query(f"WITH {fx.PART} SELECT i, ch, v FROM px")
def palette_apply(spark, sf_dir):
    rows = fx.part_pixels(spark, sf_dir)
    colours = px.palette(rows)
    return px.palette_apply(px.palette_encode(rows, colours), colours).select("i", "ch", "v")


@query(f"""WITH {fx.EV8}, pal AS (SELECT DISTINCT image_id, v FROM px)
SELECT image_id, (count(*) + 1)::BIGINT AS palette_bytes, printf('%02X', count(*)::INT - 1) || string_agg(printf('%02X', v), '' ORDER BY v) AS palette_hex FROM pal GROUP BY image_id""")
def palette_bytes(spark, sf_dir):
    return px.palette_sizes(px.palette(fx.event_pixels(spark, sf_dir)))


@query(f"WITH {fx.PART} SELECT ch, count(DISTINCT v)::BIGINT AS n_unique FROM px GROUP BY ch")
def unique_values(spark, sf_dir):
    return px.channel_summary(fx.part_pixels(spark, sf_dir)).select("ch", "n_unique")


@query(f"WITH {fx.EV8} SELECT image_id, i, ((v - coalesce(lag(v) OVER (PARTITION BY image_id ORDER BY i), 0) + 256) % 256)::INT AS d FROM px")
def delta_filter(spark, sf_dir):
    return px.delta(fx.event_pixels(spark, sf_dir)).select("image_id", "i", "d")


@query(f"WITH {fx.EMB} SELECT image_id, i, (sum(v) OVER (PARTITION BY image_id ORDER BY i) % 256)::INT AS v FROM px")
def prefix_sum(spark, sf_dir):
    return px.prefix_sum(fx.embedding_pixels(spark, sf_dir), "v").select("image_id", "i", "v")


@query(f"WITH {fx.EV8} SELECT image_id, i, v FROM px")
def undelta(spark, sf_dir):
    return px.prefix_sum(px.delta(fx.event_pixels(spark, sf_dir))).select("image_id", "i", "v")


@query(f"""WITH {fx.PART}, enc AS (SELECT i, ch, dense_rank() OVER (PARTITION BY ch ORDER BY v) - 1 AS idx FROM px)
SELECT i, ch, ((idx - coalesce(lag(idx) OVER (PARTITION BY ch ORDER BY i), 0) + 256) % 256)::INT AS d FROM enc""")
def palette_then_delta(spark, sf_dir):
    rows = fx.part_pixels(spark, sf_dir)
    return px.delta(px.palette_encode(rows, px.palette(rows)).withColumnRenamed("idx", "v")).select("i", "ch", "d")


@query(f"WITH {fx.PART} SELECT i, (2 - ch)::INT AS ch, v FROM px")
def rgb_swap(spark, sf_dir):
    return px.swap_rgb(fx.part_pixels(spark, sf_dir)).select("i", "ch", "v")


@query(f"WITH {fx.PART} SELECT i // 50 AS y, i % 50 AS x, ch, v FROM px")
def yx_coords(spark, sf_dir):
    return px.coordinates(fx.part_pixels(spark, sf_dir), fx.PART_WIDTH).select("y", "x", "ch", "v")


# Checksum, header, container


def _lanes(source: str) -> str:
    lane = lambda k, start, m: f"list_reduce(list_prepend({start}::BIGINT, list_slice(b, {k + 1}, len(b), 4)), lambda h, x: (xor(h, x) * {m}) & 4294967295)"
    cols = ", ".join(f"{lane(k, s, m)} AS h{k}" for k, (s, m) in enumerate(zip((305419896, 2596069104, 4275878552, 2271560481), (31, 37, 41, 43), strict=True)))
    return f"SELECT *, ((xor(h0, h1 >> 3) + xor(h2, (h3 << 5) & 4294967295)) & 4294967295)::BIGINT AS checksum FROM (SELECT *, {cols} FROM {source})"


_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::INT::BIGINT)"


@query(f"SELECT doc_id, checksum FROM ({_lanes('(SELECT doc_id, ' + _BYTES.format('text') + ' AS b FROM documents)')})")
def checksum_docs(spark, sf_dir):
    ship(spark)
    return fx.table(spark, sf_dir, "documents").select("doc_id", arrow.rl_checksum(F.col("text").cast("binary")).alias("checksum"))


@query(f"SELECT p_partkey, checksum FROM ({_lanes('(SELECT p_partkey, ' + _BYTES.format('p_name') + ' AS b FROM part)')})")
def checksum_sql(spark, sf_dir):
    """The same as an expression, without Python."""
    return fx.table(spark, sf_dir, "part").select("p_partkey", arrow.checksum_sql(F.col("p_name").cast("binary")).alias("checksum"))


_FLAGS = (1, 3, 5, 7)


@query(f"""WITH {fx.EV8}, r AS (SELECT image_id, i, v, dense_rank() OVER (PARTITION BY image_id ORDER BY v) - 1 AS idx FROM px),
f AS (SELECT unnest([1, 3, 5, 7]) AS config),
w AS (SELECT config, image_id, i, CASE WHEN config & 4 = 4 THEN idx ELSE v END AS s FROM r, f),
d AS (SELECT config, image_id, i, CASE WHEN config & 2 = 2 THEN (s - coalesce(lag(s) OVER (PARTITION BY config, image_id ORDER BY i), 0) + 256) % 256 ELSE s END AS s FROM w),
g AS (SELECT config, image_id, count(*) AS n, list(s::BIGINT ORDER BY i) AS b FROM d GROUP BY config, image_id),
p AS (SELECT image_id, count(DISTINCT v) + 1 AS pal FROM px GROUP BY image_id),
c AS ({_lanes('g')})
SELECT image_id, 1348096048::BIGINT AS magic, 8::BIGINT AS bpp_ext, 1::BIGINT AS channels_ext, n::BIGINT AS width, 1::BIGINT AS height, 8::BIGINT AS bpp_int, 1::BIGINT AS channels_int,
  checksum, config::BIGINT AS config, CASE WHEN config & 4 = 4 THEN pal ELSE 0 END::BIGINT AS palette_bytes, (40 + n + CASE WHEN config & 4 = 4 THEN pal ELSE 0 END)::BIGINT AS payload_size
FROM c JOIN p USING (image_id)""")
def header_fields(spark, sf_dir):
    whole = fx.event_images(spark, sf_dir, 0).drop("configuration").withColumn("configuration", F.explode(F.array(*map(F.lit, _FLAGS))))
    coded = arrow.encode_images(whole, ["image_id"])
    le = F.conv(F.concat(*[F.hex(F.substring("content", k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    return arrow.headers(coded.withColumn("payload_size", le), ["image_id", "payload_size"])


def _sums(df: DataFrame, keys: list[str], bpp: int = 8) -> DataFrame:
    """n, sum_v and sum_iv of each image's samples, by a kernel."""
    import numpy as np

    def one(raw):
        if raw is None:
            return None, None, None
        v = np.frombuffer(raw, np.uint8 if bpp == 8 else ">u2").astype(np.int64)
        return len(v), int(v.sum()), int((v * np.arange(len(v))).sum())

    return arrow._stage(df, keys, ["pixels"], "n long, sum_v long, sum_iv long", one)


def _round_trip(images: DataFrame, bpp: int = 8) -> DataFrame:
    coded = arrow.encode_images(images, ["image_id"])
    return _sums(arrow.decode_images(coded, ["image_id"]), ["image_id"], bpp)


_FLAT = "SELECT image_id::VARCHAR AS image_id, count(*)::BIGINT AS n, sum(v)::BIGINT AS sum_v, sum(v * k)::BIGINT AS sum_iv FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, ch) - 1 AS k FROM px) GROUP BY image_id"
for _name, _flags in (("pack", 1), ("delta", 3), ("palette", 5), ("all", 7)):

    @query(f"WITH {fx.EV8} {_FLAT}", f"roundtrip_{_name}")
    def _events(spark, sf_dir, flags=_flags):
        return _round_trip(fx.event_images(spark, sf_dir, flags))

    @query(f"WITH {fx.PART} {_FLAT}", f"roundtrip_rgb_{_name}")
    def _parts(spark, sf_dir, flags=_flags):
        return _round_trip(fx.part_images(spark, sf_dir, flags)).withColumn("image_id", F.col("image_id").cast("string"))


@query(f"WITH {fx.EV16} {_FLAT}")
def roundtrip16(spark, sf_dir):
    return _round_trip(fx.event_images(spark, sf_dir, 7, 16), 16)


_META_SQL = """SELECT vec_id AS image_id, len(embedding)::BIGINT AS width, 1::BIGINT AS height, 8 AS bpp, 1 AS channels, 8 AS bpp_internal, 1 AS ch_internal, 3 AS configuration, NULL::VARCHAR AS reason FROM embeddings"""


@query(_META_SQL)
def info_meta(spark, sf_dir):
    return arrow.info_images(arrow.encode_images(fx.embedding_images(spark, sf_dir), ["image_id"]), ["image_id"])


@query(_META_SQL)
def info_headers_only(spark, sf_dir):
    return arrow.info_images(arrow.encode_images(fx.embedding_images(spark, sf_dir), ["image_id"]), ["image_id"], verify=False)


DAMAGE = ("none", "too_small", "bad_size", "zstd", "size_mismatch", "magic", "bounds", "checksum")


def damaged(content: bytes, kind: str) -> bytes:
    """A container with one fault."""
    import zstandard

    raw = bytearray(container.payload(content))
    again = lambda b: struct.pack("<I", len(b)) + zstandard.ZstdCompressor().compress(bytes(b))
    if kind == "too_small":
        return content[:4]
    if kind == "bad_size":
        return struct.pack("<I", container.MAX_PAYLOAD + 1) + content[4:]
    if kind == "zstd":
        return content[:4] + b"\x00" * (len(content) - 4)
    if kind == "size_mismatch":
        return struct.pack("<I", len(raw) + 1) + content[4:]
    if kind == "magic":
        raw[0] ^= 1
        return again(raw)
    if kind == "bounds":
        return again(raw[:-1])
    if kind == "checksum":
        raw[-1] ^= 1
        return again(raw)
    return content


@query("""SELECT event_type AS image_id, kind, CASE WHEN kind <> 'none' THEN kind END AS reason
FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(['none', 'too_small', 'bad_size', 'zstd', 'size_mismatch', 'magic', 'bounds', 'checksum']) AS kind)""")
def corrupt_reasons(spark, sf_dir):
    coded = arrow.encode_images(fx.event_images(spark, sf_dir, 7), ["image_id"]).withColumn("kind", F.explode(F.array(*map(F.lit, DAMAGE))))
    broken = arrow._stage(coded, ["image_id", "kind"], ["content", "kind"], "content binary", lambda c, k: (damaged(c, k),))
    return arrow.decode_images(broken, ["image_id", "kind"]).select("image_id", "kind", "reason")


@query(f"WITH {fx.PART} {_FLAT} UNION ALL ({('WITH ' + fx.EV16 + ' ' + _FLAT)})")
def pnm_roundtrip(spark, sf_dir):
    def there_and_back(images, bpp):
        keyed = images.withColumn("image_id", F.col("image_id").cast("string"))
        return _sums(arrow.parse_pnm(arrow.write_pnm(keyed, ["image_id"]), ["image_id"]), ["image_id"], bpp)

    return there_and_back(fx.part_images(spark, sf_dir, 1), 8).unionAll(there_and_back(fx.event_images(spark, sf_dir, 1, 16), 16))


_PNM = (
    ("p5", b"P5\n2 1\n255\n\x01\x02"), ("p6", b"P6\n1 1\n255\n\x01\x02\x03"), ("p5_16", b"P5\n1 1\n65535\n\x01\x00"), ("stamp", b"P5\n#TIMESTAMP 123\n1 1\n255\n\x07"),
    ("space_first", b"P5\n3 1\n255\n\x20\x0a\x20"), ("short", b"P5\n2 2\n255\n\x01"), ("maxval", b"P5\n1 1\n15\n\x01"), ("ascii", b"P2\n1 1\n255\n1"), ("header", b"P5\nx 1\n255\n1"),
)


@query("""SELECT * FROM (VALUES ('p5', 2, 1, 8, 1, NULL, '0102', NULL), ('p6', 1, 1, 8, 3, NULL, '010203', NULL), ('p5_16', 1, 1, 16, 1, NULL, '0100', NULL), ('stamp', 1, 1, 8, 1, 123, '07', NULL),
('space_first', 3, 1, 8, 1, NULL, '200A20', NULL), ('short', NULL, NULL, NULL, NULL, NULL, NULL, 'short_raster'), ('maxval', NULL, NULL, NULL, NULL, NULL, NULL, 'maxval'),
('ascii', NULL, NULL, NULL, NULL, NULL, NULL, 'magic'), ('header', NULL, NULL, NULL, NULL, NULL, NULL, 'header')) t(name, width, height, bpp, channels, timestamp, samples, reason)""")
def pnm_headers(spark, sf_dir):
    blobs = spark.createDataFrame([(n, bytearray(b)) for n, b in _PNM], "name string, content binary")
    return arrow.parse_pnm(blobs, ["name"]).select("name", "width", "height", "bpp", "channels", "timestamp", F.hex("pixels").alias("samples"), "reason")


@query(f"WITH {fx.PART} {_FLAT}")
def api_write_read(spark, sf_dir):
    """Through files: write to the shared folder, read it back."""
    from rasterloom import api

    path = f"{shared_dir(spark)}/rasterloom/api-{uuid.uuid4().hex}"
    api.write(fx.part_images(spark, sf_dir, 0).withColumn("path", F.concat(F.lit("a/"), F.col("image_id").cast("string"), F.lit(".rlc"))), path, use_rle=True, use_palette=True)
    back = api.read(spark, path).select(F.regexp_extract("path", r"/a/([^/]*)\.rlc$", 1).alias("image_id"), "pixels")
    return _sums(back, ["image_id"])


# Flags


@query("""SELECT f AS flags, (f & 1 = 1) AS compressed, (f & 2 = 2) AS delta, (f & 4 = 4) AS palette,
CASE WHEN f & 6 = 6 THEN 'RLE+PALETTE' WHEN f & 2 = 2 THEN 'RLE' WHEN f & 4 = 4 THEN 'PALETTE' ELSE 'none' END AS names FROM (SELECT unnest(range(0, 16))::INT AS f)""")
def flags_decode(spark, sf_dir):
    f = F.col("flags")
    rows = spark.range(16).select(F.col("id").cast("int").alias("flags"))
    return rows.select("flags", *[(f.bitwiseAND(b) == b).alias(n) for n, b in (("compressed", 1), ("delta", 2), ("palette", 4))], co.flag_names(f).alias("names"))


@query("SELECT * FROM (VALUES ('compress', 3), ('compress-palette', 7), ('pack', 1), ('other', NULL)) t(mode, flags)")
def mode_flags(spark, sf_dir):
    rows = spark.createDataFrame([(m,) for m in ("compress", "compress-palette", "pack", "other")], "mode string")
    return rows.select("mode", co.mode_flags(F.col("mode")).alias("flags"))


# Collections


@query(f"WITH {fx.FILES} SELECT src.stem, src.path, src.length, dst.path AS b_path, dst.length AS b_length FROM src JOIN dst USING (stem)")
def pair_inner(spark, sf_dir):
    return co.pair(fx.document_files(spark, sf_dir), fx.label_files(spark, sf_dir)).select("stem", "path", "length", "b_path", "b_length")


@query(f"WITH {fx.FILES} SELECT src.path, dst.path AS b_path FROM src JOIN dst USING (stem) ORDER BY src.path LIMIT 100")
def pair_limit(spark, sf_dir):
    return co.first(co.pair(fx.document_files(spark, sf_dir), fx.label_files(spark, sf_dir)).select("path", "b_path"), "path", 100)


@query(f"""WITH {fx.FILES}, twice AS (SELECT stem FROM src UNION ALL SELECT stem FROM src WHERE stem LIKE '%7')
SELECT stem || '.rlc' AS missing FROM (SELECT stem FROM twice EXCEPT ALL SELECT stem FROM dst) UNION ALL SELECT stem || '.png' FROM (SELECT stem FROM dst EXCEPT ALL SELECT stem FROM twice)""")
def parity_missing(spark, sf_dir):
    a = fx.document_files(spark, sf_dir)
    return co.parity(a.unionAll(a.where("stem like '%7'")), fx.label_files(spark, sf_dir), ".png", ".rlc")


_EQUIVALENT = {".pnm": (".png", ".jpg"), ".ppm": (".png",)}


@query("""WITH n AS (SELECT * FROM (VALUES ('rgb8.pnm'), ('sample.ppm'), ('depth.tif')) t(name)),
e AS (SELECT * FROM (VALUES ('.pnm', '.png'), ('.pnm', '.jpg'), ('.ppm', '.png')) t(ext, other))
SELECT name, regexp_replace(name, '\\.[^.]*$', '') || other AS equivalent FROM n LEFT JOIN e ON '.' || regexp_extract(name, '[^.]*$') = ext""")
def equiv_lookup(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("rgb8.pnm", "sample.ppm", "depth.tif")], "name string")
    other = spark.createDataFrame([(e, o) for e, all_of in _EQUIVALENT.items() for o in all_of], "ext string, other string")
    rows = names.withColumn("ext", co.extension(F.col("name"))).join(F.broadcast(other), "ext", "left")
    return rows.select("name", F.concat(co.stem(F.col("name")), "other").alias("equivalent"))


def _perturbed(spark, sf_dir):
    a = fx.embedding_pixels(spark, sf_dir)
    off = F.when((F.col("image_id") % 3 == 0) & (F.col("i") % 5 == 0), F.col("image_id") % 7).otherwise(0)
    b = a.withColumn("v", F.least(F.lit(255), F.col("v") + off).cast("int")).where("image_id % 11 <> 4 or i < 60")
    return px.compare(a, b)


_COMPARE = f"""{fx.EMB}, two AS (SELECT image_id, i, ch, least(255, v + CASE WHEN image_id % 3 = 0 AND i % 5 = 0 THEN image_id % 7 ELSE 0 END)::INT AS w FROM px WHERE image_id % 11 <> 4 OR i < 60),
j AS (SELECT image_id, count(*) FILTER (WHERE w IS NULL OR v IS NULL) = 0 AS same, max(abs(v - w)) AS m, avg(((v - w) * (v - w))::DOUBLE) AS mse FROM px FULL JOIN two USING (image_id, i, ch) GROUP BY image_id),
c AS (SELECT image_id, same AS same_shape, (same AND m = 0) AS identical, CASE WHEN same THEN m::INT END AS max_diff, CASE WHEN same AND m > 0 THEN round(10 * log10(65025 / mse), 6) END AS psnr FROM j)"""


@query(f"WITH {_COMPARE} SELECT * FROM c")
def pixel_compare(spark, sf_dir):
    return _perturbed(spark, sf_dir)


@query(f"WITH {_COMPARE} SELECT count(*)::BIGINT AS pairs, count(*) FILTER (WHERE NOT identical)::BIGINT AS mismatches FROM c")
def pixel_identity(spark, sf_dir):
    return _perturbed(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("identical")).alias("mismatches"))


@query(f"""WITH {_COMPARE} SELECT image_id, CASE WHEN identical THEN 'IDENTICAL' ELSE 'DIFF  max=' || coalesce(max_diff::VARCHAR, 'None') || CASE WHEN psnr IS NOT NULL THEN printf('  PSNR=%.1f dB', psnr) ELSE '' END END AS label FROM c""")
def labels(spark, sf_dir):
    return _perturbed(spark, sf_dir).select("image_id", co.pixel_label(F.col("identical"), F.col("max_diff"), F.col("psnr")).alias("label"))


@query(f"""WITH {fx.FILES} SELECT round(avg(r), 6) AS ratio_mean, round(min(r), 6) AS ratio_min, round(max(r), 6) AS ratio_max, round(stddev_pop(r), 6) AS ratio_stddev
FROM (SELECT src.length / dst.length AS r FROM src JOIN dst USING (stem))""")
def ratio_stats(spark, sf_dir):
    both = co.pair(fx.document_files(spark, sf_dir), fx.label_files(spark, sf_dir))
    return both.agg(*co.ratio_stats(F.col("length") / F.col("b_length")))


@query(f"""WITH {fx.FILES} SELECT sum(src.length)::BIGINT AS src_bytes, sum(dst.length)::BIGINT AS dst_bytes, round(sum(src.length) / sum(dst.length), 6) AS ratio, round((1 - sum(dst.length) / sum(src.length)) * 100, 6) AS saving_pct FROM src JOIN dst USING (stem)""")
def ratio_overall(spark, sf_dir):
    return co.pair(fx.document_files(spark, sf_dir), fx.label_files(spark, sf_dir)).agg(*co.size_totals(F.col("length"), F.col("b_length")))


@query(f"WITH {fx.FILES} SELECT stem, floor(src.length * 100 / dst.length) / 100 AS ratio FROM src JOIN dst USING (stem)")
def ratio_trunc(spark, sf_dir):
    return co.pair(fx.document_files(spark, sf_dir), fx.label_files(spark, sf_dir)).select("stem", co.truncated_ratio(F.col("length"), F.col("b_length")).alias("ratio"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events),
l AS (SELECT event_type, list(value ORDER BY value) AS v FROM r WHERE nth > 1 GROUP BY event_type) SELECT event_type, v[len(v) // 2 + 1] AS median FROM l""")
def upper_median(spark, sf_dir):
    return co.upper_median(fx.table(spark, sf_dir, "events"), ["event_type"], "event_id", "value")


_TIMES = "t AS (SELECT event_type AS label, value AS compress_ms, abs(value - 50) AS decompress_ms, value / 7 AS ratio, (event_id % 97 <> 13 OR event_type = 'view') AS identical FROM events)"


def _times(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("label"), F.col("value").alias("compress_ms"), F.abs(F.col("value") - 50).alias("decompress_ms"), (F.col("value") / 7).alias("ratio"),
        ((F.col("event_id") % 97 != 13) | (F.col("event_type") == "view")).alias("identical"),
    )


@query(f"""WITH {_TIMES}, b AS (SELECT label, min(compress_ms) AS best_a, min(decompress_ms) AS best_b FROM t GROUP BY label)
SELECT label, best_a, best_b, round(CASE WHEN best_a <> 0 THEN (best_a - best_b) / best_a * 100 END, 6) + 0.0::DOUBLE AS gain_pct, CASE WHEN best_b < best_a THEN 'b' ELSE 'a' END AS winner,
round(CASE WHEN least(best_a, best_b) <> 0 THEN greatest(best_a, best_b) / least(best_a, best_b) END, 6) AS speedup FROM b""")
def best_of(spark, sf_dir):
    return co.best_of(_times(spark, sf_dir), ["label"], "compress_ms", "decompress_ms")


@query(f"WITH {_TIMES} SELECT arg_min(label, net) AS best_label, min(net) AS net_ms FROM (SELECT label, greatest(avg(decompress_ms) - 3.0, 0.0) AS net FROM t GROUP BY label)")
def best_label(spark, sf_dir):
    net = _times(spark, sf_dir).groupBy("label").agg(co.net_time(F.avg("decompress_ms"), F.lit(3.0)).alias("net"))
    return net.agg(F.min_by("label", "net").alias("best_label"), F.min("net").alias("net_ms"))


@query(f"WITH {_TIMES} SELECT label, round(avg(compress_ms), 6) AS avg_compress_ms, round(avg(decompress_ms), 6) AS avg_decompress_ms, round(avg(ratio), 6) AS avg_ratio, bool_and(identical) AS all_identical FROM t GROUP BY label")
def summary_by_label(spark, sf_dir):
    return co.summary_by_label(_times(spark, sf_dir))


@query(f"WITH {_TIMES} SELECT label, round(avg(compress_ms), 6) AS mean_ms, printf('%8.1f ms', avg(compress_ms)) AS shown FROM t GROUP BY label")
def mean_timing(spark, sf_dir):
    return _times(spark, sf_dir).groupBy("label").agg(F.avg("compress_ms").alias("m")).select("label", F.round("m", 6).alias("mean_ms"), co.fmt_ms(F.col("m")).alias("shown"))


@query(f"WITH {fx.FILES} SELECT count(*) FILTER (WHERE dst.stem IS NOT NULL)::BIGINT AS ok, count(*) FILTER (WHERE dst.stem IS NULL)::BIGINT AS err FROM src LEFT JOIN dst USING (stem)")
def ok_err_counts(spark, sf_dir):
    done = fx.label_files(spark, sf_dir).select("stem", F.lit(True).alias("done"))
    rows = fx.document_files(spark, sf_dir).join(done, "stem", "left")
    return rows.agg(F.count_if(F.col("done").isNotNull()).alias("ok"), F.count_if(F.col("done").isNull()).alias("err"))


@query(f"WITH {fx.FILES} SELECT count(*)::BIGINT AS n_files, round(sum(length) / 2.5 / 1e6, 6) AS mb_per_s, round(2500.0 / count(*), 6) AS ms_per_file, round(count(*) / 2.5, 6) AS files_per_s FROM src")
def throughput(spark, sf_dir):
    n = F.count(F.lit(1))
    return fx.document_files(spark, sf_dir).agg(
        n.alias("n_files"), F.round(F.sum("length") / 2.5 / 1e6, 6).alias("mb_per_s"), F.round(F.lit(2500.0) / n, 6).alias("ms_per_file"), F.round(n / 2.5, 6).alias("files_per_s")
    )


@query(f"WITH {fx.FILES} SELECT path FROM src ORDER BY md5('0' || path), path LIMIT 20")
def sample_k(spark, sf_dir):
    return co.sample(fx.document_files(spark, sf_dir).select("path"), "path", 20)


_NAMES = ("a/b/One.PNG", "two.tar.gz", "/x/.hidden", "noext", "d.ir/file", "x.ppm")


@query(r"""WITH n AS (SELECT * FROM (VALUES ('a/b/One.PNG', 'One.PNG', 'One', '.png', 'a/b/One.rlc', true), ('two.tar.gz', 'two.tar.gz', 'two.tar', '.gz', 'two.tar.rlc', false), ('/x/.hidden', '.hidden', '.hidden', '', '/x/.hidden.rlc', false),
('noext', 'noext', 'noext', '', 'noext.rlc', false), ('d.ir/file', 'file', 'file', '', 'd.ir/file.rlc', false), ('x.ppm', 'x.ppm', 'x', '.ppm', 'x.rlc', true)) t(path, name, stem, ext, swapped, image)) SELECT * FROM n""")
def path_parts(spark, sf_dir):
    p = F.col("path")
    rows = spark.createDataFrame([(n,) for n in _NAMES], "path string")
    return rows.select("path", co.base_name(p).alias("name"), co.stem(p).alias("stem"), co.extension(p).alias("ext"), co.swap_suffix(p, ".rlc").alias("swapped"), co.extension(p).isin(*co.IMAGE_EXTENSIONS).alias("image"))


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages""")
def url_parts(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"))


@query("""WITH s AS (SELECT doc_id, octet_length(encode(text))::BIGINT * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 3 END) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 1000000000 THEN printf('%.3f GB', n / 1e9) WHEN n >= 1000000 THEN printf('%.2f MB', n / 1e6) WHEN n >= 1000 THEN printf('%.1f KB', n / 1e3) ELSE printf('%d B', n) END AS shown FROM s""")
def fmt_bytes(spark, sf_dir):
    factor = F.element_at(F.array(*map(F.lit, (1, 1000, 1000000, 3))), (F.col("doc_id") % 4 + 1).cast("int"))
    n = F.octet_length("text").cast("long") * factor
    return fx.table(spark, sf_dir, "documents").select("doc_id", co.fmt_bytes(n).alias("shown"))


@query(f"WITH {fx.FILES} SELECT path FROM src WHERE stem IN (SELECT stem FROM dst)")
def subset_semi(spark, sf_dir):
    return fx.document_files(spark, sf_dir).join(fx.label_files(spark, sf_dir), "stem", "left_semi").select("path")


# Trees of files


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/rasterloom/{label}-{uuid.uuid4().hex}"


def _put(df: DataFrame, root: str) -> None:
    """Writes each row's ``content`` to its ``path`` below a folder."""
    import posixpath

    from rasterloom.sources.files import _fs

    def one(path, content):
        where, top = _fs(root)
        final = posixpath.join(top, path)
        where.create_dir(posixpath.dirname(final), recursive=True)
        with where.open_output_stream(final) as f:
            f.write(content)
        return (len(content),)

    arrow._stage(df, ["path"], ["path", "content"], "size long", one).write.format("noop").mode("overwrite").save()


def _anymaps(spark, sf_dir, name: str) -> DataFrame:
    """path, content: an anymap of each event type, all of one name in folders of their own."""
    return arrow.write_pnm(fx.event_images(spark, sf_dir, 1), ["image_id"]).select(F.concat("image_id", F.lit("/" + name)).alias("path"), "content")


def _by_folder(images: DataFrame) -> DataFrame:
    return _sums(images.select(F.element_at(F.split("path", "/"), -2).alias("image_id"), "pixels"), ["image_id"])


@query(f"WITH {fx.EV8} {_FLAT}")
def tree_encode(spark, sf_dir):
    """A folder tree of equal names is encoded to the same tree."""
    from rasterloom import api

    source, target = _folder(spark, "tree"), _folder(spark, "tree-encoded")
    _put(_anymaps(spark, sf_dir, "x.pgm"), source)
    api.encode_tree(spark, source, target, pictures_too=False, use_rle=True)
    return _by_folder(api.read(spark, target))


@query(f"WITH {fx.EV8} {_FLAT}")
def format_read(spark, sf_dir):
    """The data source reads what the SQL function encoded."""
    from rasterloom.sources.files import register

    register(spark)
    arrow.register(spark)
    root = _folder(spark, "format")
    images = fx.event_images(spark, sf_dir, 3)
    _put(images.select(F.concat("image_id", F.lit("/x.rlc")).alias("path"), arrow.rl_encode("pixels", "width", "height", "bpp", "channels", "configuration").alias("content")), root)
    return _by_folder(spark.read.format("rasterloom").load(root))


@query(f"WITH {fx.EV16} {_FLAT}")
def sql_functions(spark, sf_dir):
    """rl_encode and rl_decode as expressions."""
    ship(spark)
    coded = fx.event_images(spark, sf_dir, 7, 16).select("image_id", arrow.rl_encode("pixels", "width", "height", "bpp", "channels", "configuration").alias("content"))
    return _sums(coded.select("image_id", arrow.rl_decode("content").alias("image")).select("image_id", "image.pixels"), ["image_id"], 16)


@query("SELECT * FROM (VALUES ('kept.rlc', 2), ('new.rlc', 3)) t(name, width)")
def overwrite_files(spark, sf_dir):
    """After mode overwrite only that job's files are there."""
    from rasterloom import api

    root = _folder(spark, "overwrite")
    row = lambda name, n: (name, n, 1, 8, 1, bytearray(range(n)))
    for mode, rows in ((False, [row("old.rlc", 1), row("kept.rlc", 1)]), (True, [row("kept.rlc", 2), row("new.rlc", 3)])):
        api.write(spark.createDataFrame(rows, "path string, width long, height long, bpp int, channels int, pixels binary"), root, overwrite=mode)
    return api.info(spark, root, verify=False, direct=True).select(co.base_name(F.col("path")).alias("name"), F.col("width").cast("int").alias("width"))


@query(f"WITH {fx.PART} {_FLAT}")
def picture_files(spark, sf_dir):
    """PNG files through Spark's image source."""
    import struct as st
    import zlib

    def png(raw, width, height, channels):
        part = lambda kind, data: st.pack(">I", len(data)) + kind + data + st.pack(">I", zlib.crc32(kind + data))
        step = width * channels
        lines = b"".join(b"\0" + raw[k : k + step] for k in range(0, len(raw), step))
        return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", st.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b""),)

    from rasterloom import api

    root = _folder(spark, "pictures")
    _put(arrow._stage(fx.part_images(spark, sf_dir, 1).withColumn("path", F.concat("image_id", F.lit("/p.png"))), ["path"], ["pixels", "width", "height", "channels"], "content binary", png), root)
    return _by_folder(api.pictures(spark, root))


_TREES = """src AS (SELECT doc_id % 7 || '/' || doc_id // 7 AS place, octet_length(encode(text))::BIGINT AS length FROM documents),
dst AS (SELECT doc_id % 7 || '/' || doc_id // 7 AS place, (octet_length(encode(text)) // 2 + 1)::BIGINT AS length FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(f"WITH {_TREES} SELECT place, 'src/' || place || '.png' AS path, src.length, 'dst/' || place || '.rlc' AS b_path, dst.length AS b_length FROM src JOIN dst USING (place)")
def pair_relative(spark, sf_dir):
    """Files of two trees by their place, where names alone repeat."""
    place = F.concat((F.col("stem").cast("long") % 7).cast("string"), F.lit("/"), F.floor(F.col("stem").cast("long") / 7).cast("string"))
    tree = lambda df, root, ext: df.select(F.concat(F.lit(root + "/"), place, F.lit(ext)).alias("path"), "length")
    a, b = tree(fx.document_files(spark, sf_dir), "src", ".png"), tree(fx.label_files(spark, sf_dir), "dst", ".rlc")
    return co.pair_trees(a, "src", b, "dst").select("place", "path", "length", "b_path", "b_length")


_LISTED = ("a.png", "b.JPG", "c.txt", "sub/a.png", "sub/d.ppm", "sub/deep/e.pnm")


@query("""SELECT * FROM (VALUES ('flat', 'a.png'), ('flat', 'b.JPG'), ('first', 'a.png'), ('all', 'a.png'), ('all', 'b.JPG'), ('all', 'sub/a.png'), ('all', 'sub/d.ppm'), ('all', 'sub/deep/e.pnm'),
('glob', 'sub/deep/e.pnm'), ('glob', 'sub/d.ppm'), ('named', 'a.png'), ('named', 'sub/a.png')) t(search, place)""")
def discover_tree(spark, sf_dir):
    """Searches of a folder: flat, the first only, recursive, by a pattern, by name."""
    root = _folder(spark, "listed")
    _put(spark.createDataFrame([(n, bytearray(b"x")) for n in _LISTED], "path string, content binary"), root)
    found = {
        "flat": co.discover(spark, root), "first": co.discover(spark, root, most=1), "all": co.discover(spark, root, recursive=True),
        "glob": co.files(spark, root, recursive=True, glob="*.p[pn]m"), "named": co.files(spark, root, recursive=True).where("stem = 'a'"),
    }
    rows = None
    for search, df in found.items():
        part = df.select(F.lit(search).alias("search"), co.below(spark, F.col("path"), root).alias("place"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


@query("""SELECT * FROM (VALUES ('grey8', 3, 2, 8, 1, 6), ('rgb8', 3, 2, 8, 3, 18), ('grey16', 3, 2, 16, 1, 12), ('rgb16', 3, 2, 16, 3, 36)) t(name, width, height, bpp, channels, size)""")
def array_input(spark, sf_dir):
    """Arrays as images, and back."""
    import numpy as np

    from rasterloom import api

    rows = []
    for name, shape, kind in (("grey8", (2, 3), np.uint8), ("rgb8", (2, 3, 3), np.uint8), ("grey16", (2, 3), np.uint16), ("rgb16", (2, 3, 3), np.uint16)):
        a = np.arange(np.prod(shape)).reshape(shape).astype(kind)
        r = api.from_array(a)
        assert (api.to_array(r) == a).all()
        rows.append((name, r["width"], r["height"], r["bpp"], r["channels"], len(r["pixels"])))
    return spark.createDataFrame(rows, "name string, width int, height int, bpp int, channels int, size int")


@query("""SELECT * FROM (VALUES ('bpp', 'bpp must be 8 or 16, not 12'), ('palette', 'a palette holds at most 8 byte channels, not 9'), ('short', '3 bytes, but the dimensions need 4'),
('sound', NULL), ('zero', 'width, height and channels must be positive')) t(name, error)""")
def refused_images(spark, sf_dir):
    rows = [("sound", 2, 2, 8, 1, 3, 4), ("zero", 0, 2, 8, 1, 1, 0), ("bpp", 2, 2, 12, 1, 1, 4), ("short", 2, 2, 8, 1, 1, 3), ("palette", 1, 1, 8, 9, 5, 9)]
    images = spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in rows], "name string, width long, height long, bpp int, channels int, configuration int, pixels binary")
    return arrow.encode_images(images, ["name"]).select("name", "error")


@query("SELECT 'compress' AS command, 0 AS code UNION ALL SELECT 'info', 0 UNION ALL SELECT 'decompress', 0 UNION ALL SELECT 'info damaged', 1 UNION ALL SELECT 'no command', 1")
def command_codes(spark, sf_dir):
    """Exit codes of the command line."""
    import contextlib
    import io

    from rasterloom.__main__ import main

    source, coded, back, bad = (_folder(spark, f"command-{k}") for k in range(4))
    _put(_anymaps(spark, sf_dir, "x.pgm"), source)
    _put(spark.createDataFrame([("bad.rlc", bytearray(b"1234"))], "path string, content binary"), bad)
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        rows = [("compress", main(["compress-palette", source, coded])), ("info", main(["info", coded])), ("decompress", main(["decompress", coded, back])), ("info damaged", main(["info", bad])), ("no command", main(["nothing"]))]
    return spark.createDataFrame(rows, "command string, code int")


@query()
def discover_files(spark, sf_dir):
    return co.discover(spark, sf_dir, (".parquet",), recursive=True).select("stem", "ext", "length")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

