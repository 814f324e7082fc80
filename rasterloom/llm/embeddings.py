"""Near-duplicate embeddings by product quantisation, with an exact cosine rerank.

Equal vectors are one class first, so a vector that a third of all rows share is one
row. Class vectors are indexed by coarse inverted lists (spherical k-means on a
bounded sample) and residual subspace codes; every class is stored in the list of
its nearest centroid and looks into every list that a bound cannot rule out: by the
angle to its centroid less the list's radius, or by the distance to the plane that
parts it from the query's own list. So no link is lost, however many lists there are.

In a list, a query's table of subspace products gives the asymmetric distance to
each code by table lookups. The code's own error bounds the true cosine, so the
lookups drop only what cannot link; the rest is reranked by the exact cosine in
double precision, and nothing below the limit is ever a link.

Small lists share a region and large ones are dealt into several. A task compares the
members of two regions that look into each other's lists, so each pair meets in one
task. It returns link counts and a star for each component, never pairs, so a dense
list stays small.

Defined results: a vector that is null, zero, empty or holds a null or non-finite component
links with nothing and is its own component; vectors of different lengths never
link; rows that repeat an id are vectors of one component; a null id has a null
component and is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.graph import components, stars
from rasterloom.session import drop_stored, local_table, ship, stored

LIMIT = 0.9
#: Classes that train the index, at most, and lists at most: about the root of the number of classes.
SAMPLE, MAX_LISTS = 16_384, 4096
#: Bytes of that sample, at most: long vectors make it smaller.
SAMPLE_BYTES = 64 << 20
#: Codewords of a subspace, and its dimensions.
CODEWORDS, SUBSPACE = 256, 8
#: Vectors of a region, at most about, and their bytes.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Queries and stored vectors that a task compares at once.
QUERIES, STORED = 256, 1024
#: Vector lengths that get an index of their own, the commonest; vectors of other lengths are compared in blocks without one.
INDEXED_LENGTHS = 64


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    """Centroids; empty ones start anew at points of the sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best = np.empty(len(x), np.int64)
        half = (c * c).sum(axis=1) / 2
        for i in range(0, len(x), 4096):
            best[i : i + 4096] = (x[i : i + 4096] @ c.T - half).argmax(axis=1)
        n = np.bincount(best, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Index:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = kmeans(sample, lists, 12, 1, spherical=True)
        residual = sample - self.centroids[(sample @ self.centroids.T).argmax(axis=1)]
        self.cuts = np.append(np.arange(0, sample.shape[1], SUBSPACE), sample.shape[1])
        self.books = [kmeans(residual[:, a:b], CODEWORDS, 8, 2 + k) for k, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True))]

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The nearest lists of each vector, nearest first."""
        sims = unit @ self.centroids.T
        n = min(n, sims.shape[1])
        some = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)

    def reaches(self, unit: np.ndarray, home: np.ndarray, nearest: np.ndarray, lists: np.ndarray, limit: float) -> np.ndarray:
        """Whether a member of each of ``lists`` may have the cosine ``limit`` with each vector.

        nearest: the least cosine to its centroid of any member of each of ``lists``.
        """
        c = self.centroids[lists]
        sims = unit @ c.T
        turn = np.arccos(np.clip(limit, -1, 1)) + 1e-6
        ok = np.arccos(np.clip(sims, -1, 1)) - np.arccos(np.clip(nearest, -1, 1)) <= turn
        if limit > 0:
            # members are on the far side of the plane between the two centroids
            own = self.centroids[home]
            lead = (unit * own).sum(axis=1)[:, None] - sims
            apart = np.sqrt(np.maximum((own * own).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (own @ c.T), 0))
            ok &= (lead <= np.sin(turn) * apart) | (apart < 1e-4)
        return ok

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        residual = unit - self.centroids[home]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            part = residual[:, a:b]
            codes[:, k] = (part @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
            residual[:, a:b] -= book[codes[:, k]]
        return codes, np.linalg.norm(residual, axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace the products of its codewords (rows) with the queries (columns)."""
        return [(book @ queries[:, a:b].T).astype(np.float32) for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)]


def estimates(tables: list[np.ndarray], codes: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    """Asymmetric products of stored codes (rows) with queries (columns): a table lookup for each subspace, added to the centroids' products."""
    found = np.empty_like(coarse)
    for k, table in enumerate(tables):
        np.take(table, codes[:, k], axis=0, out=found, mode="clip")
        coarse += found
    return coarse


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(spark: SparkSession, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dims, key, raw of each row: key and raw are null where a vector links with nothing."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            dims, key, raw = [], [], []
            for v in batch.column("vector"):
                x = None if v.as_py() is None or v.values.null_count else np.asarray(v.values, "<f8") + 0.0
                # scaled by its largest component, so that no length overflows
                top = np.abs(x).max(initial=0) if x is not None else 0
                ok = x is not None and len(x) and np.isfinite(x).all() and top > 0
                data = (x / top).tobytes() if ok else None
                dims.append(len(x) if ok else None)
                raw.append(data)
                key.append(xxh3_128_digest(data) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dims", "key", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return stored(spark, rows.mapInArrow(run, "vec_id long, dims int, key binary, raw binary"), "vectors")


def _regions(count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first region of each list and its number of regions: large lists have their own, small ones share."""
    parts = np.maximum(-(-count // block), 1)
    base = np.zeros(len(count), np.int64)
    n, room = 0, 0
    for c in np.flatnonzero(parts == 1).tolist():
        if count[c] > room:
            n, room = n + 1, block
        base[c], room = n - 1, room - count[c]
    large = parts > 1
    base[large] = n + np.cumsum(parts[large]) - parts[large]
    return base, parts


def _links(spark: SparkSession, classes: DataFrame, dims: int, n: int, limit: float, block: int) -> DataFrame:
    """a, b, links among the classes (rep, copies, raw) of one vector length: counts (b null) and stars (links null)."""
    import pyarrow as pa

    place = F.pmod(F.xxhash64(F.lit("index"), "rep"), F.lit(1 << 30))
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = classes.where(place < int((1 << 30) * min(1.0, 0.95 * most / n))).orderBy(place, "rep").limit(most) if n > most else classes
    rows = sorted((r.rep, bytes(r.raw)) for r in sample.select("rep", "raw").collect())
    index = Index(unit_rows([r for _, r in rows]), int(np.clip(round(n**0.5), 1, MAX_LISTS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = unit_rows(batch.column("raw").to_pylist())
            home = index.probes(unit, 1)[:, 0]
            codes, error = index.encode(unit, home)
            near = (unit * index.centroids[home]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "copies", "raw")] + [pa.array(home), pa.array(near), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["rep", "copies", "raw", "home", "near", "code", "error"])

    placed = stored(spark, classes.select("rep", "copies", "raw").mapInArrow(assign, "rep long, copies long, raw binary, home int, near double, code binary, error double"), "placed")
    shape = placed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).orderBy("home").collect()  # MAX_LISTS rows at most
    lists, nearest = np.array([r.home for r in shape]), np.array([r.near for r in shape])
    base, parts = _regions(np.array([r.n for r in shape]), max(1, min(block, BLOCK_BYTES // (8 * index.centroids.shape[1]))))
    region_list = np.repeat(np.arange(len(lists)), parts)  # a list and each of its regions
    regions = np.repeat(base, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    number = int(regions.max()) + 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                unit, home = unit_rows(batch.column("raw").to_pylist()), batch.column("home").to_numpy()
                at = np.searchsorted(lists, home)
                mine = base[at] + batch.column("own").to_numpy() % parts[at]
                met = np.zeros((len(unit), number), bool)
                i, c = np.nonzero(index.reaches(unit, home, nearest, lists, limit)[:, region_list])
                met[i, regions[c]] = True
                met[np.arange(len(unit)), mine] = True
                i, other = np.nonzero(met)
                r, s, side = np.minimum(mine[i], other), np.maximum(mine[i], other), np.sign(mine[i] - other) + 1
                # 4096 rows at a time: a vector may go to many regions
                for k0 in range(0, len(i), 4096):
                    part = slice(k0, k0 + 4096)
                    rows = pa.array(i[part])
                    # only the greater region's members are looked up by code
                    code = batch.column("code").take(pa.array(i[part], mask=side[part] == 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r[part].astype(np.int32)), pa.array(s[part].astype(np.int32)), pa.array(side[part].astype(np.int32))] + [batch.column(c).take(rows) for c in ("rep", "copies", "raw", "home", "error")] + [code],
                        ["r", "s", "side", "rep", "copies", "raw", "home", "error", "code"],
                    )

    own = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).alias("own")
    met = placed.select("rep", "copies", "raw", "home", "error", "code", own).mapInArrow(visit, "r int, s int, side int, rep long, copies long, raw binary, home int, error double, code binary")
    met = met.repartition("r", "s").sortWithinPartitions("r", "s")

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # side: 0 in the lesser region, 2 in the greater, 1 where the two are one
        side, home = group.column("side").to_numpy(), group.column("home").to_numpy()
        stored_at, asking_at = np.flatnonzero(side >= 1), np.flatnonzero(side <= 1)
        if not len(stored_at) or not len(asking_at):
            return
        stored_at, asking_at = (x[np.argsort(home[x], kind="stable")] for x in (stored_at, asking_at))
        found = Links(group)
        code, error = group.column("code"), group.column("error").to_numpy()
        codes = np.frombuffer(b"".join(code.take(pa.array(stored_at)).to_pylist()), np.uint8).reshape(len(stored_at), -1)
        slack = (limit - 1e-5 - error[stored_at]).astype(np.float32)[:, None]
        held, own = np.unique(home[stored_at], return_inverse=True)
        near = nearest[np.searchsorted(lists, held)]
        for i0 in range(0, len(asking_at), QUERIES):
            some = asking_at[i0 : i0 + QUERIES]
            x = found.unit[some]
            tables, coarse = index.tables(x), (index.centroids[held] @ x.T).astype(np.float32)
            wanted = np.flatnonzero(index.reaches(x, home[some], near, held, limit).any(axis=0)[own])
            for j0 in range(0, len(wanted), STORED):
                those = wanted[j0 : j0 + STORED]
                j, i = np.nonzero(estimates(tables, codes[those], coarse[own[those]]) >= slack[those])
                found.check(some[i], stored_at[those[j]], len(those) * len(some), limit)
        yield from found.rows()

    out = stored(spark, met.mapInArrow(_by_group(("r", "s"), one), "a long, b long, links long"), "vector-links")
    drop_stored(spark, placed)
    return out


def _plain_links(spark: SparkSession, classes: DataFrame, limit: float, block: int) -> DataFrame:
    """As :func:`_links`, for vectors of lengths that few have: blocks of a length meet in pairs and are compared without an index."""
    import pyarrow as pa

    sizes = classes.groupBy(F.col("dims").alias("_dims")).agg(F.count(F.lit(1)).alias("n"))
    rows = classes.join(sizes, F.col("dims") == F.col("_dims")).withColumn("parts", F.ceil(F.greatest(F.col("n") / block, F.col("n") * F.col("dims") * 8 / BLOCK_BYTES)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 1).when(F.col("mine") < F.col("other"), 0).otherwise(2).cast("int")
    met = rows.select("dims", F.least("mine", "other").alias("r"), F.greatest("mine", "other").alias("s"), side.alias("side"), "rep", "copies", "raw")

    def one(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side = group.column("side").to_numpy()
        stored_at, asking_at = np.flatnonzero(side >= 1), np.flatnonzero(side <= 1)
        if not len(stored_at) or not len(asking_at):
            return
        found = Links(group)
        for i0 in range(0, len(asking_at), QUERIES):
            some = asking_at[i0 : i0 + QUERIES]
            i, j = np.nonzero(found.unit[some] @ found.unit[stored_at].T >= limit)
            found.check(some[i], stored_at[j], 0, limit)
        yield from found.rows()

    met = met.repartition("dims", "r", "s").sortWithinPartitions("dims", "r", "s")
    return stored(spark, met.mapInArrow(_by_group(("dims", "r", "s"), one), "a long, b long, links long"), "vector-links")


class Links:
    """Links among the rows of a group: a count for each row, and a component label."""

    def __init__(self, group):
        self.rep, self.copies, self.side = (group.column(c).to_numpy() for c in ("rep", "copies", "side"))
        self.unit = unit_rows(group.column("raw").to_pylist())
        self.links, self.label = np.zeros(len(self.rep)), np.arange(len(self.rep))

    def check(self, i: np.ndarray, j: np.ndarray, dense: int, limit: float) -> None:
        """Exact cosines of the candidate pairs; dense: how many pairs they were chosen from."""
        rep, label = self.rep, self.label
        ok = (self.side[i] == 0) | (rep[i] < rep[j])  # inside a region each pair once
        i, j = i[ok], j[ok]
        if not len(i):
            return
        if len(i) * 8 > dense > 0:
            x, y = np.unique(i), np.unique(j)
            exact = (self.unit[x] @ self.unit[y].T)[np.searchsorted(x, i), np.searchsorted(y, j)]
        else:
            exact = np.concatenate([np.einsum("nd,nd->n", self.unit[i[k : k + 65536]], self.unit[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        i, j = i[exact >= limit], j[exact >= limit]
        self.links += np.bincount(i, self.copies[j], len(rep)) + np.bincount(j, self.copies[i], len(rep))
        fresh = label[i] != label[j]
        if fresh.any():
            before = np.flatnonzero(label != np.arange(len(rep)))
            self.label = stars(len(rep), np.append(i[fresh], before), np.append(j[fresh], label[before]))

    def rows(self) -> Iterator:
        import pyarrow as pa

        some, joined = np.flatnonzero(self.links > 0), np.flatnonzero(self.label != np.arange(len(self.rep)))
        yield pa.RecordBatch.from_arrays([pa.array(self.rep[some]), pa.nulls(len(some), pa.int64()), pa.array(self.links[some].astype(np.int64))], ["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(self.rep[joined]), pa.array(self.rep[self.label[joined]]), pa.nulls(len(joined), pa.int64())], ["a", "b", "links"])


def _by_group(keys: tuple[str, ...], one):
    """``one`` over the rows of each value of ``keys``, which lie together; a group may span batches."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, ...] | None = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in keys])
            edge = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if a == b:
                    continue
                now = tuple(key[:, a].tolist())
                if held and now != last:
                    yield from one(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield from one(pa.Table.from_batches(held).combine_chunks())

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``."""
    ship(spark)
    rows = _classes(spark, vectors, id_col, vector_col)
    known = rows.where("key is not null and vec_id is not null")
    classes = stored(spark, known.groupBy("key", "dims").agg(F.min(F.struct("vec_id", "raw")).alias("c"), F.count(F.lit(1)).alias("copies")).select("key", "dims", F.col("c.vec_id").alias("rep"), "c.raw", "copies"), "vector-classes")
    lengths = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").limit(INDEXED_LENGTHS + 1).collect()
    found = [_links(spark, classes.where(F.col("dims") == r.dims), r.dims, r.n, limit, block) for r in lengths[:INDEXED_LENGTHS]]
    if len(lengths) > INDEXED_LENGTHS:
        found.append(_plain_links(spark, classes.where(~F.col("dims").isin([r.dims for r in lengths[:INDEXED_LENGTHS]])), limit, block))
    links = local_table(spark, [], "a long, b long, links long")
    for f in found:
        links = links.unionAll(f)
    roots = components(spark, links.where("b is not null"))
    counts = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = classes.select("key", "rep", "copies").join(counts, "rep", "left").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    of_class = of_class.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = known.select("vec_id", "key").join(of_class, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
