"""Token files by plane shuffling.

A segment file holds the ids of a run of documents. The ids are cut into blocks of
a fixed number; a block is transposed, so that the k-th bytes (or bits) of all its
ids lie together, and each plane is compressed by zstandard on its own. A plane of
zeros only is not stored. An index at the end gives every chunk's place, count,
checksum and plane sizes, so a range of ids is read without its neighbours.

    "PLN1"  planes:u8 (8 = bytes, 1 = bits)  block:u32  ids:u64  docs:u32  chunks:u32
    document index (zstd): doc_id:i64[docs], known:u8[docs], count:u64[docs]
    chunks: planes one after another
    chunk index: (offset:u64, ids:u32, crc32:u32, plane size:u32[planes])[chunks]
    document index size:u32  chunk index offset:u64  "PLN1"

All numbers are little-endian. Segments travel as rows of a Parquet table, whose
writer commits whole tasks, on any store that Spark reaches.

Defined results: a null text is an empty document, of the end id alone; null ids
come first in the order; rows that repeat an id stand next to each other, ordered
by a hash of the text; an empty table gives no segments; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import tokens
from rasterloom.llm.prefix import starts
from rasterloom.session import ship, stored

MAGIC = b"PLN1"
_HEAD = struct.Struct("<4sBIQII")
_CHUNK = struct.Struct("<QII")
_TAIL = struct.Struct("<IQ4s")
#: Ids of a block.
BLOCK = 65_536
#: A segment is closed once it holds this many ids.
SEGMENT_IDS = 1 << 20
#: Segments of a file of the table: bounds what a reader's batch holds.
SEGMENTS_PER_FILE = 16
LEVEL = 3
#: Segment starts are broadcast up to this many segments (24 bytes each).
BROADCAST_SEGMENTS = 1_000_000


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The planes of one block: of 4 bytes (width 8) or 32 bits (width 1) each id has."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        return [p.tobytes() if p.any() else b"" for p in as_bytes.T]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little").T
    return [np.packbits(p).tobytes() if p.any() else b"" for p in bits]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    if width == 8:
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8))[:n]
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], width: int = 8, block: int = BLOCK) -> bytes:
    """One file image from documents' ids."""
    import zstandard

    z = zstandard.ZstdCompressor(level=LEVEL)
    flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype("<u4")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = z.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + np.array([len(x) for x in ids], "<u8").tobytes())
    parts, chunks = [b"", index], []
    at = _HEAD.size + len(index)
    for first in range(0, len(flat), block):
        part = flat[first : first + block]
        planes = [z.compress(p) if p else b"" for p in to_planes(part, width)]
        chunks.append(_CHUNK.pack(at, len(part), zlib.crc32(part)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        parts += planes
        at += sum(map(len, planes))
    parts[0] = _HEAD.pack(MAGIC, width, block, len(flat), len(doc_ids), len(chunks))
    return b"".join([*parts, *chunks, _TAIL.pack(len(index), at, MAGIC)])


class Segment:
    """Reads a file image; only the chunks that a range needs are decompressed."""

    def __init__(self, image: bytes):
        import zstandard

        self.image, self._z = image, zstandard.ZstdDecompressor()
        magic, self.width, self.block, self.n_ids, n_docs, n_chunks = _HEAD.unpack_from(image)
        index_size, at, tail = _TAIL.unpack_from(image, len(image) - _TAIL.size)
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a plane file")
        raw = self._z.decompress(image[_HEAD.size : _HEAD.size + index_size]) if n_docs else b""
        known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n_docs), known, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self._planes = 32 // self.width
        size = _CHUNK.size + 4 * self._planes
        self._index = [(*_CHUNK.unpack_from(image, at + k * size), struct.unpack_from(f"<{self._planes}I", image, at + k * size + _CHUNK.size)) for k in range(n_chunks)]

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc, sizes = self._index[k]
        planes = []
        for s in sizes:
            planes.append(self._z.decompress(self.image[at : at + s]) if s else b"")
            at += s
        ids = from_planes(planes, n, self.width)
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        """``count`` ids from place ``start`` of this segment."""
        end = self.n_ids if count is None else min(self.n_ids, start + count)
        if end <= start:
            return np.zeros(0, "<u4")
        first = start // self.block
        got = np.concatenate([self.chunk(k) for k in range(first, (end - 1) // self.block + 1)])
        return got[start - first * self.block : end - first * self.block]


def write_ids(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, width: int = 8, block: int = BLOCK, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments (part, seq, n_ids, image) of all documents in ascending id order, as a stored table."""
    import pyarrow as pa

    ship(spark)
    path = vocabulary or tokens.vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [size], "image": [write_segment(held, ids, width, block)]})

        for batch in batches:
            keys = batch.column("doc_id")
            for first, texts in tokens.runs(batch.column("text")):
                flat, ends = tokens.encoder(path).encode(texts)
                for key, a, b in zip(keys.slice(first, len(texts)).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    held.append(key)
                    ids.append(flat[a:b])
                    size += b - a
                    if size >= segment_ids:
                        yield row()
                        seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the last two keys only part rows that share an id, so that no id fills one partition
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "mark", "nth").sortWithinPartitions("doc_id", "mark", "nth")
    segments = rows.select("doc_id", "text").mapInArrow(encode, "part int, seq int, n_ids long, image binary")
    return stored(spark, segments, "planes", maxRecordsPerFile=SEGMENTS_PER_FILE)


def export_files(spark: SparkSession, segments: DataFrame, folder: str) -> DataFrame:
    """path, n_ids: each segment as a file ``<part>-<seq>.pln`` of its own, in the order of their names; a store that pyarrow reaches.

    A file is written under another name and moved, so it is whole or not there, and a task that runs twice writes the same files.
    """
    import posixpath

    import pyarrow as pa
    from pyarrow import fs

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(root, recursive=True)
        for batch in batches:
            paths = []
            for part, seq, image in zip(*(batch.column(c) for c in ("part", "seq", "image")), strict=True):
                final = posixpath.join(root, f"{part.as_py():06d}-{seq.as_py():06d}.pln")
                held = f"{final}.{TaskContext.get().taskAttemptId()}.part"
                with where.open_output_stream(held) as f:
                    f.write(image.as_buffer())
                where.move(held, final)
                paths.append(final)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column("n_ids")], ["path", "n_ids"])

    return segments.mapInArrow(run, "path string, n_ids long")


def read_documents(spark: SparkSession, segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    import pyarrow as pa

    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column("base"), batch.column("image"), strict=True):
                seg = Segment(image.as_py())
                ids = seg.ids()
                ends = np.cumsum(seg.counts)
                starts = ends - seg.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, pa.int64()), pa.array(starts + base.as_py()), pa.array(seg.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_part = starts(segments.groupBy(F.col("part").alias("_p_part")).agg(F.sum("n_ids").alias("n")), "_p_part", "n").select("_p_part", "start")
    inside = segments.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inside"))
    places = inside.join(of_part, F.col("part") == F.col("_p_part")).select("part", "seq", (F.col("start") + F.col("inside")).alias("base"))
    if segments.select("part").count() <= BROADCAST_SEGMENTS:
        places = F.broadcast(places)
    rows = segments.join(places, ["part", "seq"]).select("base", "image")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
