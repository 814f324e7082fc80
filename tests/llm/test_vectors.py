import numpy as np
import pytest

from rasterloom.llm import embeddings
from rasterloom.llm.graph import components, stars


def brute(vectors, limit=0.9):
    ok = [i for i, (_, v) in enumerate(vectors) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    u = {i: np.asarray(vectors[i][1], float) / np.linalg.norm(vectors[i][1]) for i in ok}
    edges = [(i, j) for k, i in enumerate(ok) for j in ok[k + 1 :] if len(u[i]) == len(u[j]) and u[i] @ u[j] >= limit]
    degree = np.bincount([x for e in edges for x in e], minlength=len(vectors))
    label = stars(len(vectors), np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
    return degree, label


def clustered(n=600, dims=32, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    rows = [(i, (centres[i % 12] + r.normal(size=dims) * (0.2 if i % 3 else 2.0)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(300)]  # a third are copies of one vector


def test_against_all_pairs(spark):
    rows = clustered()
    got = {r.vec_id: r for r in embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=128).collect()}
    degree, label = brute([(i, np.asarray(v, np.float32)) for i, v in rows])
    assert [got[i].n_links for i, _ in rows] == degree.tolist()
    assert [got[i].component_id for i, _ in rows] == label.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i, _ in rows)


@pytest.mark.parametrize("cosine", [0.901, 0.92])
def test_no_link_is_lost_at_the_limit(spark, cosine):
    """Pairs just above the limit, in high dimension: the hardest for the lists."""
    r = np.random.default_rng(5)
    base = r.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = cosine * base + np.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = dict(embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links").collect())
    degree, _ = brute(rows)
    assert (degree > 0).all() and [got[i] for i, _ in rows] == degree.tolist()


def test_more_lengths_than_indexes(spark, monkeypatch):
    """Lengths beyond the indexed ones are compared in blocks; none is refused."""
    r = np.random.default_rng(3)
    rows = []
    for dims in range(2, 92):
        for _ in range(12 if dims < 80 else 3):
            centre = r.normal(size=dims)
            rows += [(centre + r.normal(size=dims) * 0.2).tolist() for _ in range(2)]
    rows = list(enumerate(rows))
    for indexed in (64, 2):
        monkeypatch.setattr(embeddings, "INDEXED_LENGTHS", indexed)
        part = rows if indexed == 2 else [x for x in rows if len(x[1]) < 5]
        got = {x.vec_id: x for x in embeddings.near_vectors(spark, spark.createDataFrame(part, "vec_id long, embedding array<double>"), block=8).collect()}
        degree, label = brute(part)
        assert [got[i].n_links for i, _ in part] == degree.tolist() and [got[i].component_id for i, _ in part] == label.tolist()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [3.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (11, [-1.0, 0.0]), (12, [-0.0, 1e30]), (13, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rep string, n_links int")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark, df).collect())
    assert got == sorted(
        [(False, 1, 1, 1, True), (False, 2, 1, 1, False), (False, 3, 0, 3, True), (False, 4, 0, 4, True), (False, 5, 0, 5, True), (False, 6, 0, 6, True), (False, 7, 0, 7, True), (False, 8, 0, 8, True),
         (False, 9, 1, 9, True), (False, 10, 1, 9, False), (True, 0, 0, None, True), (False, 11, 1, 11, True), (False, 11, 1, 11, True), (False, 12, 1, 12, True), (False, 13, 1, 12, False)]
    )


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_estimates_bound_the_cosine():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embeddings.Index(x, 10)
    home = index.probes(x, 1)[:, 0]
    codes, error = index.encode(x, home)
    for c in range(10):
        mine = home == c
        coarse = np.repeat((index.centroids[c] @ x.T)[None].astype(np.float32), mine.sum(), axis=0)
        gap = np.abs(embeddings.estimates(index.tables(x), codes[mine], coarse) - x[mine] @ x.T)
        assert (gap <= error[mine][:, None] + 1e-5).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.u: r.v for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 60)}
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_dense_group_loses_no_link(spark):
    """A third of the vectors mutually near but unequal: split into many lists, each link still found."""
    r = np.random.default_rng(11)
    centre = r.normal(size=64)
    near = centre + r.normal(size=(3500, 64)) * np.linalg.norm(centre) / 8 * np.sqrt(r.uniform(0.03, 0.12, size=(3500, 1)))
    x = np.concatenate([near, r.normal(size=(7000, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    degree = np.concatenate([(unit[k : k + 500] @ unit.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(unit), 500)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = dict(embeddings.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links").collect())
    assert 1_000_000 < degree.sum() and [got[i] for i in range(len(x))] == degree.tolist()
