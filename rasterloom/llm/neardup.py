"""Near-duplicate documents by HyperMinHash, banding and exact verification.

1. One pass over the texts: the size of each document's shingle set, a digest of
   the set, its sketch and its band keys, as a stored table of some 400 bytes a
   document. Documents with equal sets are one class from here on, so thousands
   of copies are one row.
2. Band keys held by several classes are buckets; buckets with the same members
   are kept once. A bucket of many members is dealt into blocks, and each pair of
   blocks is a group of bounded size for a task.
3. In a group, sketches are compared by collision-corrected estimates. The
   first round lets through a spanning forest of the likely links only. They are
   confirmed on the full sets, and confirmed links make components.
4. The second round looks at buckets that still hold several components, with the
   full sets at hand, and at likely pairs between components only: these are
   confirmed or refuted inside the task, which returns a star for each component
   it found. So every candidate pair is confirmed, refuted or already inside one
   component, while a group of copies never becomes all its pairs.

Defined results: a null text or one without words has an empty set, links with
nothing and is kept; rows that repeat an id belong to one document of that id,
each by its own text; a null id is kept and has a null component; an empty table
gives no rows; other columns are ignored by :func:`near_duplicates` and carried by
:func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import hyperminhash as hm
from rasterloom.llm.graph import components, stars
from rasterloom.session import drop_stored, few_files, ship, stored

#: Links have at least this similarity, in hundredths.
PERCENT = 80
#: Estimates this many standard deviations below the limit are still verified.
MARGIN = 4.0
#: Pairs whose smaller set has fewer shingles are verified whatever their estimate: most of their registers are borrowed.
SMALL = 64
#: Members of a block; a group is two blocks.
BLOCK = 1024
#: Bytes of full sets in a block, about; a task holds some ten times that.
BLOCK_BYTES = 6 << 20
#: Texts that a task works on at least, where there are as many.
TEXTS_PER_FILE = 2048
#: Candidate ids are broadcast to the scan of the texts up to this many (8 bytes each).
BROADCAST_IDS = 2_000_000


def sketches(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest, registers, bands of each row: a stored table."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                n, digest, regs, bands = [], [], [], []
                for text in batch.column("text"):
                    s = hm.shingles(text.as_py(), words)
                    n.append(len(s))
                    digest.append(xxh3_128_digest(s) if len(s) else None)
                    r = hm.sketch(s) if len(s) else None
                    regs.append(r.tobytes() if len(s) else None)
                    bands.append(hm.band_keys(r) if len(s) else np.zeros(0, np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), flat], ["doc_id", "mark", "n_shingles", "digest", "registers", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = few_files(rows, docs.count(), TEXTS_PER_FILE)
    return stored(spark, rows.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, registers binary, bands array<long>"), "sketches")


def buckets(spark: SparkSession, classes: DataFrame, n: int) -> DataFrame:
    """bucket, rep, m (its members): every bucket of two classes or more, equal buckets once."""
    keyed = classes.select("rep", F.explode("bands").alias("bucket"))
    shape = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("rep")).alias("x"))
    once = shape.where("m > 1").groupBy("m", "s", "x").agg(F.min("bucket").alias("bucket"))
    return stored(spark, keyed.join(once.select("bucket", "m"), "bucket"), "buckets", rows=hm.BANDS * n)


def grouped(members: DataFrame, details: DataFrame, blocks: Column) -> DataFrame:
    """group_id, side, and the columns of members and details: each pair of blocks of a bucket is a group, its rows together in a task.

    side: 0 in the group's first block, 1 in its second, 2 where the group is one block.
    """
    rows = members.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("group_id", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = rows.select("group_id", "rep", side.cast("int").alias("side"), "comp").join(details, "rep")
    return rows.repartition("group_id").sortWithinPartitions("group_id")


class Group:
    """Members of one group: rep, side, comp, n, registers, and full sets where they are given."""

    def __init__(self, columns: dict[str, np.ndarray], percent: int, sets: list[np.ndarray] | None = None):
        self.rep, self.side, self.comp, self.n, self.regs = (columns[c] for c in ("rep", "side", "comp", "n", "registers"))
        self.percent, self.sets = percent, sets
        share = percent / 100
        # only registers that a shingle fell into are independent
        filled = hm.REGISTERS * -np.expm1(-np.maximum(self.n, 1) / hm.REGISTERS)
        self.low = np.where(self.n < SMALL, -np.inf, share - MARGIN * np.sqrt(share * (1 - share) / filled))

    def likely(self, i: np.ndarray, j: np.ndarray, equal: np.ndarray, apart: bool) -> tuple[np.ndarray, ...]:
        """i, j, estimate of those given pairs that may link; apart: only between components."""
        n, side = self.n, self.side
        ok = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * self.percent) & ((side[i] != side[j]) | (side[i] == 2))
        if apart:
            ok &= self.comp[i] != self.comp[j]
        i, j, equal = i[ok], j[ok], equal[ok]
        estimate = hm.corrected(equal, n[i], n[j]) if len(i) else np.zeros(0)
        ok = estimate >= np.minimum(self.low[i], self.low[j])
        return i[ok], j[ok], estimate[ok]

    def chunks(self, apart: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """i, j, estimate of the likely pairs, some rows of i at a time."""
        for i0 in range(0, len(self.n) - 1, 64):
            equal = (self.regs[i0 : i0 + 64, None, :] == self.regs[None, i0 + 1 :, :]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(equal >= np.minimum(self.low[i0 : i0 + 64, None], self.low[None, i0 + 1 :]) * hm.REGISTERS)
            ahead = j >= i
            i, j = i[ahead], j[ahead]
            i, j, estimate = self.likely(i + i0, j + i0 + 1, equal[i, j], apart)
            yield i.astype(np.int32), j.astype(np.int32), estimate.astype(np.float32)

    def all_likely(self, apart: bool) -> tuple[np.ndarray, ...]:
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)), *self.chunks(apart)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the likely links, the likeliest first."""
        i, j, estimate = self.all_likely(False)
        order = np.argsort(-estimate, kind="stable")
        kept = spanning(len(self.n), i[order], j[order])
        return self.rep[i[order][kept]], self.rep[j[order][kept]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Exact links between earlier components, of which some would connect what these connect already."""
        if len(np.unique(self.comp)) < 2:
            return self.rep[:0], self.rep[:0]
        m, size = len(self.n), np.array([len(s) for s in self.sets])
        number, term = np.unique(np.concatenate(self.sets), return_inverse=True)
        owner = np.repeat(np.arange(m, dtype=np.int32), size)[np.argsort(term, kind="stable")]
        ends = np.cumsum(np.bincount(term, minlength=len(number)))
        many = np.diff(ends, prepend=0)
        first = np.cumsum(size) - size
        label = np.unique(self.comp, return_inverse=True)[1]
        # a document of a rarer component looks its shingles up for all its partners at once
        weight = np.bincount(label)[label]
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for i, j, _ in self.chunks(True):
            open_ = label[i] != label[j]  # what is in one component by now needs no check
            i, j = i[open_], j[open_]
            swap = weight[i] > weight[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            good = np.zeros(len(i), bool)
            edge = np.append(np.flatnonzero(np.append(True, np.diff(i) != 0)), len(i)) if len(i) else [0]
            for a, b in zip(list(edge[:-1]), list(edge[1:]), strict=True):
                x = i[a]
                t = term[first[x] : first[x] + size[x]]
                long = many[t]
                places = np.repeat(ends[t] - np.cumsum(long), long) + np.arange(long.sum())
                both = np.bincount(owner[places], minlength=m)[j[a:b]]
                good[a:b] = 100 * both >= self.percent * (size[x] + size[j[a:b]] - both)
            if good.any():
                i, j = i[good], j[good]
                new = spanning(len(label), label[i], label[j])
                found.append((i[new], j[new]))
                label = stars(len(label), label[i], label[j])[label]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.rep[i], self.rep[j]


def spanning(n: int, i: np.ndarray, j: np.ndarray, some: int = 1 << 16) -> np.ndarray:
    """Places of edges that make a spanning forest of n nodes, earlier edges first: each component takes its first edge, over and over."""
    label, kept = np.arange(n), [np.zeros(0, int)]
    for k in range(0, len(i), some):
        a, b = i[k : k + some], j[k : k + some]
        while True:
            x, y = label[a], label[b]
            left = np.flatnonzero(x != y)
            if not len(left):
                break
            best = np.full(n, len(a))
            np.minimum.at(best, x[left], left)
            np.minimum.at(best, y[left], left)
            new = np.unique(best[best < len(a)])
            kept.append(new + k)
            label = stars(n, x[new], y[new])[label]
    return np.concatenate(kept)


def _pairs(a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def by_group(percent: int, full: bool):
    """The kernel over :func:`grouped` rows: forests of likely links, or with full sets the exact stars."""
    import pyarrow as pa

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        out = {c: table.column(c).to_numpy() for c in ("group_id", "rep", "side", "comp", "n")}
        out["registers"] = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, hm.REGISTERS)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ids = held.column("group_id").to_numpy()
            start = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0  # sorted: the last group may go on
            if start:
                yield from work(held.slice(0, start))
                held = held.slice(start).combine_chunks()
        if held is not None and held.num_rows:
            yield from work(held)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = arrays(table)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()] if full else None
        edge = np.append(np.flatnonzero(np.append(True, np.diff(columns["group_id"]) != 0)), table.num_rows)
        if not full:
            x = edge[:-1][np.diff(edge) == 2]  # most groups: compared all at once
            g = Group(columns, percent)
            i, j, _ = g.likely(x, x + 1, (g.regs[x] == g.regs[x + 1]).sum(axis=1), False)
            yield _pairs(g.rep[i], g.rep[j])
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if e - s > (1 if full else 2):
                g = Group({c: v[s:e] for c, v in columns.items()}, percent, sets[s:e] if full else None)
                yield _pairs(*(g.links() if full else g.forest()))

    return run


def full_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """rep, shingles (sorted hashes) of the documents in ``ids``: a stored table."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([hm.shingles(t.as_py(), words).tobytes() for t in batch.column("text")], pa.binary())], ["rep", "shingles"])

    ids = _small(ids)
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text")).join(ids, "rep", "left_semi")
    return stored(spark, few_files(rows, docs.count(), TEXTS_PER_FILE).mapInArrow(run, "rep long, shingles binary"), "full-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity asked for."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    rows = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    rows = rows.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, mark (a hash of the text) for each row of ``docs``."""
    ship(spark)
    marks = sketches(spark, docs, id_col, text_col, words)
    # binary and array values move as the struct of the least id, so classes combine before the exchange
    one = F.min(F.struct("doc_id", "n_shingles", "registers", "bands")).alias("c")
    classes = marks.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(one).select("digest", F.col("c.doc_id").alias("rep"), "c.n_shingles", "c.registers", "c.bands")
    n_docs = marks.count()
    classes = stored(spark, classes, "classes", rows=n_docs, per_file=8 * TEXTS_PER_FILE)
    n = classes.count()
    members = buckets(spark, classes, n)
    sketch = classes.select("rep", F.col("n_shingles").alias("n"), "registers")
    alone = members.withColumn("comp", F.col("rep"))
    found = grouped(alone, sketch, F.ceil(F.col("m") / block)).mapInArrow(by_group(percent, False), "a long, b long").distinct()
    pairs = stored(spark, found, "pairs", rows=hm.BANDS * n)
    n_pairs = pairs.count()
    # a document without any likely pair is in no set, and its buckets need no second look
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = full_sets(spark, docs, ids, id_col, text_col, words)
    links = stored(spark, verified(pairs, sets, percent), "links", rows=n_pairs)
    now = components(spark, links, rows=n_pairs)
    left = members.join(ids.join(sketch.select("rep", "n"), "rep"), "rep").join(now.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").withColumn("comp", F.coalesce("root", "rep"))
    shape = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles")).where("lo <> hi")
    rows = left.select("bucket", "rep", "comp").join(shape, "bucket")
    parts = F.ceil(F.greatest(F.col("k") / block, F.col("shingles") * 8 / BLOCK_BYTES))
    more = stored(spark, grouped(rows, sketch.join(sets, "rep"), parts).mapInArrow(by_group(percent, True), "a long, b long").distinct(), "links", rows=hm.BANDS * n)
    n_more = more.count()
    stars_now = components(spark, now.select(F.col("u").alias("a"), F.col("v").alias("b")).union(more), rows=n + n_more) if n_more else now
    for done in (members, pairs, sets, links, more):
        drop_stored(spark, done)
    roots = classes.select("digest", "rep").join(stars_now.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    rows = marks.select("doc_id", "mark", "n_shingles", "digest")
    out = rows.where("digest is not null").join(roots, "digest", "left").select("doc_id", "mark", "n_shingles", "root")
    out = out.unionAll(rows.where("digest is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("root")))
    root = F.when(F.col("doc_id").isNotNull(), F.col("root"))
    out = out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), "mark")
    return few_files(out, n_docs, 8 * TEXTS_PER_FILE)


def keep_one(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component.

    Rows that repeat an id are judged each by its own text; of those that stay, the
    one with the least hash of its text does, and of equal texts the first row by all columns.
    """
    found = stored(spark, near_duplicates(spark, docs, id_col=id_col, text_col=text_col, **options).where("doc_id is not null"), "near-verdicts")
    of_id = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("kept"), F.col("mark"))).alias("mark"))
    without = lambda rows, ids, how: rows.join(ids.select(F.col("doc_id").alias("_n_id")), F.col(id_col) == F.col("_n_id"), how)
    rest = without(docs, _small(of_id.where("not kept")), "left_anti")
    repeated = of_id.where("kept and n > 1")
    if repeated.isEmpty():
        return rest
    repeated = _small(repeated.select("doc_id", F.col("mark").alias("_n_mark")))
    alone = without(rest, repeated, "left_anti")
    marked = rest.withColumn("_n_hash", F.xxhash64(F.col(text_col).cast("binary"))).join(repeated.withColumnRenamed("doc_id", "_n_id"), (F.col(id_col) == F.col("_n_id")) & (F.col("_n_hash") == F.col("_n_mark")))
    row = F.struct(*docs.columns)
    return alone.unionAll(marked.groupBy("_n_id").agg(F.min_by(row, F.to_json(row)).alias("_n_row")).select("_n_row.*"))


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast within the bound, else left to a sort-merge join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
