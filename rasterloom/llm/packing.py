"""Packing token ids into sequences by a deficit round robin over source queues.

Every source is a queue of its documents' ids. The target proportions are given as
weights of the sources; without them they are the queues' shares of all ids, so that
all queues run dry together. Each window of ``length`` ids visits the sources in
order, and a source gives its share of the window plus what it is owed; the part of
an id that a share leaves over is its deficit and carries to the next window. With
weights, a phase ends where a queue runs dry and the rest share what follows by
their weights. Only the last sequence needs padding.

The deficits need no pass from window to window. Let ``served(k, w)`` be the ids
that the first k sources have given after w windows. For all sources together it
is ``length * w``; for one source fewer it is ``served(k, w) * C[k-1] // C[k]``, with
C the summed queue sizes, and the remainder of that division is the deficit. This
is monotone in w for each source, sums to whole windows and ends exactly at the
queue sizes. So any task knows the state before any window, and partitions work
on their own. Windows are taken in blocks so that all products fit 64 bits.

Documents are encoded once, into a table; a task's documents lie behind each other
in the queues of their sources, and a small table of (task, source) totals gives
each of them its place.

Defined results: a null text is an empty document, of the end id alone; a null
source is a queue of its own, the last; of more than :data:`QUEUES` sources the
largest have queues of their own and the others share :data:`SHARED` queues by a hash,
so proportions hold for these queues; a very long text is encoded whole, in pieces
where it has white space; rows that repeat are packed once each; an empty table gives
no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm import tokens
from rasterloom.session import few_files, local_table, ship, stored

LENGTH = 2048
#: Windows of a block: LENGTH * BLOCK squared stays below 2**63; numbers in a block's table, at most about.
BLOCK, TABLE = 4096, 1 << 18
#: The largest sources have queues of their own, others share queues.
QUEUES, SHARED = 1000, 24
#: Texts that a task encodes at least, where there are as many.
TEXTS_PER_FILE = 2048
#: (task, source) places are broadcast up to this many (about 32 bytes each).
BROADCAST_PLACES = 1_000_000


class Schedule:
    """Which window, and where in it, every id of every queue goes to."""

    def __init__(self, sizes: list[int], length: int = LENGTH, block: int = BLOCK):
        self.sizes, self.length, self.block = sizes, length, max(1, min(block, TABLE // (len(sizes) + 1)))
        self.total = sum(sizes)
        self.step = length * self.block
        self.edge = lru_cache(maxsize=64)(self._edge)
        self.table = lru_cache(maxsize=8)(self._table)

    def _edge(self, b: int) -> list[int]:
        """Ids that each prefix of the queues has given before block b: exact, in big integers."""
        above = sum(self.sizes)
        ahead = [min(b * self.step, above)]
        for size in reversed(self.sizes):
            ahead.append(ahead[-1] * (above - size) // above if above else 0)
            above -= size
        return ahead[::-1]

    def _table(self, b: int) -> tuple[list[int], np.ndarray]:
        """(ids that each queue gave before block b, ahead): ahead[k, w] ids of the block's first w windows are of the first k queues."""
        low, high = self.edge(b), self.edge(b + 1)
        share = [y - x for x, y in zip(low, high, strict=True)]
        ahead = np.zeros((len(share), self.block + 1), np.int64)
        ahead[-1] = np.minimum(np.arange(self.block + 1, dtype=np.int64) * self.length, share[-1])
        for k in range(len(share) - 2, -1, -1):
            ahead[k] = ahead[k + 1] * share[k] // max(1, share[k + 1])
        return [low[k + 1] - low[k] for k in range(len(self.sizes))], ahead

    def given(self, queue: int, b: int) -> int:
        e = self.edge(b)
        return e[queue + 1] - e[queue]

    def pieces(self, queue: int, start: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ids start .. start+count of a queue: (lengths, windows, offsets) of its pieces, in order."""
        b = min(start * self.total // (self.sizes[queue] * self.step), max(0, (self.total - 1) // self.step))
        while self.given(queue, b) > start:
            b -= 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        end = start + count
        while start < end:
            while self.given(queue, b + 1) <= start:
                b += 1
            before, ahead = self.table(b)
            mine = ahead[queue + 1] - ahead[queue]
            x, y = start - before[queue], min(end - before[queue], int(mine[-1]))
            first = int(np.searchsorted(mine, x, "right")) - 1
            last = int(np.searchsorted(mine, y, "left"))
            cuts = np.clip(mine[first : last + 1], x, y)
            w = np.arange(first, last)
            lengths = np.diff(cuts)
            offsets = ahead[queue, first + 1 : last + 1] - ahead[queue, first:last] + cuts[:-1] - mine[first:last]
            real = lengths > 0
            found.append((lengths[real], w[real] + b * self.block, offsets[real]))
            start = before[queue] + y
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Phases:
    """The schedules of all phases, one behind the other: within a phase each queue gives by its weight."""

    def __init__(self, sizes: list[int], weights: list[float] | None = None, length: int = LENGTH, block: int = BLOCK):
        self.length = length
        self.starts, self.before, self.schedules = [0], [[0] * len(sizes)], []
        left = list(sizes)
        while any(left):
            active = [k for k, n in enumerate(left) if n and (weights is None or weights[k] > 0)]
            if weights is None or not active:  # queues without weight come last, by their shares
                given = left
            else:
                dry = min(active, key=lambda k: left[k] / weights[k])
                given = [min(left[k], int(left[dry] * weights[k] / weights[dry])) if k in set(active) else 0 for k in range(len(left))]
                given[dry] = left[dry]
            self.schedules.append(Schedule(given, length, block))
            self.starts.append(self.starts[-1] + sum(given))
            self.before.append([a + b for a, b in zip(self.before[-1], given, strict=True)])
            left = [a - b for a, b in zip(left, given, strict=True)]

    def pieces(self, queue: int, start: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ids start .. start+count of a queue: (lengths, sequences, offsets) of its pieces, in order."""
        found, end = [], start + count
        for p, plan in enumerate(self.schedules):
            a, b = max(start, self.before[p][queue]), min(end, self.before[p + 1][queue])
            if a >= b:
                continue
            lengths, windows, offsets = plan.pieces(queue, a - self.before[p][queue], b - a)
            at = self.starts[p] + windows * self.length + offsets
            over = at % self.length + lengths - self.length  # a phase may begin inside a sequence
            if (over > 0).any():
                two = np.flatnonzero(over > 0)
                place = np.insert(at, two + 1, (at + lengths - over)[two])
                lengths = np.insert(np.where(over > 0, lengths - over, lengths), two + 1, over[two])
                at = place
            found.append((lengths, at // self.length, at % self.length))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def encoded(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str) -> DataFrame:
    """part, doc_id, source, first (ids of its source before it in its task), n, ids: a stored table."""
    import pyarrow as pa

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, queued = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for k, texts in tokens.runs(batch.column("text")):
                ids, ends = tokens.encoder(path).encode(texts)
                keys, sources = batch.column("doc_id").slice(k, len(texts)), batch.column("source").slice(k, len(texts))
                n = np.diff(ends, prepend=0)
                first = np.empty(len(n), np.int64)
                for i, (s, size) in enumerate(zip(sources.to_pylist(), n.tolist(), strict=True)):
                    first[i] = queued[s]
                    queued[s] += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), keys, sources, pa.array(first), pa.array(n), tokens.packed_lists(ids, ends)],
                    ["part", "doc_id", "source", "first", "n", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = few_files(rows, docs.count(), TEXTS_PER_FILE)  # before the stage: a partition's number must be that of one run of it
    return stored(spark, rows.mapInArrow(encode, "part int, doc_id long, source string, first long, n long, ids binary"), "packing-ids")


def queues_of(spark: SparkSession, per_task: DataFrame, weights: Mapping[str | None, float] | None) -> tuple[DataFrame, list[int], list[float] | None]:
    """(part, source) places in the queues, the queues' sizes and weights."""
    per_source = per_task.groupBy("source").agg(F.sum("n").alias("n"))
    named = per_source.orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(QUEUES).collect()
    named.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    number = local_table(spark, [(r.source, k) for k, r in enumerate(named)], "_q_source string, queue int")
    rows = per_task.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("_q_source")), "left")  # QUEUES rows at most
    shared = F.lit(len(named)) + F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int")
    rows = rows.select("part", "source", "n", F.coalesce("queue", shared).alias("queue"))
    per_queue = {r.queue: r.n for r in rows.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # QUEUES + SHARED rows at most
    sizes = [per_queue.get(k, 0) for k in range(max(per_queue, default=-1) + 1)]
    weigh = None if weights is None else [float(weights.get(named[k].source, 1.0)) if k < len(named) else 1.0 for k in range(len(sizes))]
    before = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(F.col("part").alias("p_part"), F.col("source").alias("p_source"), "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("queued")), sizes, weigh


def pack(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str | None = None,
    length: int = LENGTH, weights: Mapping[str | None, float] | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; its ids too, if asked for.

    weights: of the sources, 1 where a source is not named; without them each weighs its share of all ids.
    """
    import pyarrow as pa

    ship(spark)
    path = vocabulary or tokens.vocabulary()
    kind = tokens.vocabulary_type(path)
    ids = encoded(spark, docs, id_col, text_col, source_col, path)
    per_task = ids.groupBy("part", "source").agg(F.sum("n").alias("n"))
    places, sizes, weigh = queues_of(spark, per_task, weights)
    if per_task.count() <= BROADCAST_PLACES:
        places = F.broadcast(places)
    rows = ids.join(places, (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source")))
    rows = rows.select("doc_id", "queue", (F.col("queued") + F.col("first")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Phases(sizes, weigh, length)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                yield pieces_of(plan, batch.slice(k, 512))

    def pieces_of(plan: Phases, batch: pa.RecordBatch) -> pa.RecordBatch:
        col = {c: batch.column(c) for c in batch.schema.names}
        queues, at, counts = col["queue"].to_pylist(), col["at"].to_pylist(), col["n"].to_pylist()
        where, crc, own = [plan.pieces(q, a, n) for q, a, n in zip(queues, at, counts, strict=True)], [], []
        for (lengths, _, _), raw in zip(where, col["ids"], strict=True):
            packed, edge = memoryview(np.frombuffer(raw.as_buffer(), kind).astype("<u4").tobytes()), 0
            for n in (lengths * 4).tolist():
                crc.append(zlib.crc32(packed[edge : edge + n]))
                if with_ids:
                    own.append(bytes(packed[edge : edge + n]))
                edge += n
        many = np.array([len(x[0]) for x in where])
        lengths = np.concatenate([x[0] for x in where])
        ends = np.cumsum(lengths)
        starts = ends - lengths - np.repeat(np.cumsum(counts) - counts, many)
        row = np.repeat(np.arange(len(where)), many)
        out = {
            "doc_id": col["doc_id"].take(pa.array(row)), "start": pa.array(starts), "length": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": col["n"].take(pa.array(row)), "sequence_id": pa.array(np.concatenate([x[1] for x in where])), "offset": pa.array(np.concatenate([x[2] for x in where])),
        }
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(cut, kinds)
