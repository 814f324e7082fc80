"""``spark.read.format("rasterloom")`` and ``format("pnm")``, and their sinks.

    spark.dataSource.register(RasterSource); spark.dataSource.register(PnmSource)
    spark.read.format("rasterloom").option("mode", "meta").load(folder)
    df.write.format("rasterloom").option("palette", True).mode("append").save(folder)

The reader packs files into partitions of about :data:`PARTITION_BYTES`; filters on
``path`` are applied before any file is opened. ``mode=meta`` drops the pixels, and
with ``verify=false`` reads only as much of each file as its header needs. The writer
makes one file for each row in a folder of the job, and the commit moves the files in
parallel to their places, so that a task that runs twice, or fails, leaves nothing
behind. Two rows with one path fail the job. ``mode("overwrite")`` then removes every
other file below the target.

These sources open paths through pyarrow's file systems. On a store that only
Spark's own readers reach, use :func:`rasterloom.api.read`, which is built on
``binaryFile``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from rasterloom.functions import container, pnm

PARTITION_BYTES = 64 << 20
#: Files that a commit moves at a time.
MOVERS = 32
#: Extension of container files, unless the option ``extension`` names another.
EXTENSION = "rlc"
IMAGE_SCHEMA = "path string, width long, height long, bpp int, channels int, bpp_internal int, ch_internal int, configuration int, pixels binary, reason string"
META_SCHEMA = "path string, width long, height long, bpp int, channels int, bpp_internal int, ch_internal int, configuration int, reason string"
PNM_SCHEMA = "path string, width long, height long, bpp int, channels int, timestamp long, pixels binary, reason string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _truth(value: str | None, default: bool) -> bool:
    return default if value is None else str(value).lower() in ("1", "true", "yes")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        self.paths = tuple(paths)


class _Reader(DataSourceReader):
    """Lists, filters and packs files; subclasses turn a file's bytes into a row."""

    def __init__(self, options, schema: StructType, extension: str):
        self.root = options["path"]
        self.extension = "." + options.get("extension", extension).lstrip(".").lower()
        self.recursive = _truth(options.get("recursive"), True)
        self.schema = schema
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        for f in self.tests:
            ok = path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        where, root = _fs(self.root)
        info = where.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.extension) and self._wanted(f.path))
        packs, size = [[]], 0
        for path, n in files:
            if packs[-1] and size + n > PARTITION_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(path)
            size += n
        return [Files(p) for p in packs]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = _fs(self.root)
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                yield (path, *self.open(f))

    def open(self, f) -> tuple:
        return self.row(f.read())

    def row(self, data: bytes) -> tuple:
        raise NotImplementedError


class _RasterReader(_Reader):
    def __init__(self, options, schema):
        super().__init__(options, schema, EXTENSION)
        self.meta = options.get("mode", "image") == "meta"
        self.verify = _truth(options.get("verify"), True)

    def open(self, f):
        if not self.meta or self.verify:
            return super().open(f)
        try:
            h = container.peek_stream(f.read)
        except container.Damaged as e:
            return (None,) * 7 + (e.reason,)
        return (h["width"], h["height"], h["bpp_ext"], h["channels_ext"], h["bpp_int"], h["channels_int"], h["config"], None)

    def row(self, data):
        n = 7 if self.meta else 8
        try:
            return (*container.decode(data, pixels=not self.meta)[:n], None)
        except container.Damaged as e:
            return (None,) * n + (e.reason,)


class _PnmReader(_Reader):
    def __init__(self, options, schema, extension):
        super().__init__(options, schema, extension)

    def row(self, data):
        try:
            return (*pnm.parse(data), None)
        except pnm.BadPnm as e:
            return (None,) * 6 + (e.reason,)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.root = options["path"]
        self.options = dict(options)
        self.overwrite = overwrite
        self.held = f"_held-{uuid.uuid4().hex}"
        # made here, on the driver: a task that outlives its aborted job then finds no folder, and leaves no file
        where, root = _fs(self.root)
        where.create_dir(posixpath.join(root, self.held), recursive=True)

    def make(self, row: dict) -> bytes:
        raise NotImplementedError

    def write(self, batches) -> Written:
        where, root = _fs(self.root)
        folder = posixpath.join(root, self.held)
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                name = posixpath.normpath(row["path"].lstrip("/"))
                if name.startswith("..") or name == ".":
                    raise ValueError(f"{row['path']!r} is no path below the target")
                held = posixpath.join(folder, uuid.uuid4().hex)
                with where.open_output_stream(held) as f:
                    f.write(self.make(row))
                done.append((held, posixpath.join(root, name)))
        return Written(done)

    def commit(self, messages) -> None:
        where, root = _fs(self.root)
        files = [x for m in messages if m for x in m.files]
        final = {f for _, f in files}
        if len(final) < len(files):
            twice = [f for f, n in Counter(f for _, f in files).items() if n > 1]
            self.abort(messages)
            raise ValueError(f"{len(twice)} paths are written twice, {min(twice)} among them")
        for folder in {posixpath.dirname(f) for f in final} | {root}:
            where.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: where.move(*x), files))
            if self.overwrite:
                list(pool.map(where.delete_file, self._others(final)))
        self.abort(messages)

    def _others(self, final: set[str]) -> list[str]:
        """Files below the target that this job did not write; those of other jobs under way are left alone."""
        from pyarrow import fs

        where, root = _fs(self.root)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        return [f.path for f in found if f.type == fs.FileType.File and f.path not in final and not posixpath.relpath(f.path, root).startswith("_held-")]

    def abort(self, messages) -> None:
        """Whatever is still held goes, also that of tasks that failed."""
        from pyarrow import fs

        where, root = _fs(self.root)
        folder = posixpath.join(root, self.held)
        if where.get_file_info(folder).type == fs.FileType.Directory:
            where.delete_dir(folder)


class _RasterWriter(_Writer):
    def make(self, row):
        asked = row.get("configuration") or 0
        flags = container.USE_COMPRESSION | (container.USE_DELTA if _truth(self.options.get("rle"), False) else 0) | (container.USE_PALETTE if _truth(self.options.get("palette"), False) else 0)
        return container.encode(row["pixels"], row["width"], row["height"], row["bpp"], row["channels"], asked | flags)


class _PnmWriter(_Writer):
    def make(self, row):
        return pnm.write(row["pixels"], row["width"], row["height"], row["bpp"], row["channels"])


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return "rasterloom"

    def schema(self):
        return META_SCHEMA if self.options.get("mode") == "meta" else IMAGE_SCHEMA

    def reader(self, schema):
        return _RasterReader(self.options, schema)

    def writer(self, schema, overwrite):
        return _RasterWriter(self.options, overwrite)


class PnmSource(DataSource):
    @classmethod
    def name(cls):
        return "pnm"

    def schema(self):
        return PNM_SCHEMA

    def reader(self, schema):
        return _PnmReader(self.options, schema, self.options.get("extension", "pnm"))

    def writer(self, schema, overwrite):
        return _PnmWriter(self.options, overwrite)


def register(spark) -> None:
    from rasterloom.session import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(PnmSource)

