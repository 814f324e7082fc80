"""Hashed linear models over the distinct words of a text.

A text's features are the hashes of its distinct words, of their leading bytes, and
of the shapes of its chunks (case, trailing marks), each once. Models are sparse:
only features whose document frequency differs between the classes get a weight, so
a long text does not gather noise from its thousands of neutral words. All features
of a batch come from array operations (:mod:`rasterloom.llm.bytescan`); a worker
keeps the models' tables and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from rasterloom.llm import bytescan

#: Hash space of the features.
DIMENSIONS = 1 << 20
#: Features that get a weight, at most.
WEIGHTS = 4096
#: A feature needs this many documents of the sample, and this chi-square value.
MIN_DOCS, MIN_CHI = 4, 30.0

_WORD, _LEAD4, _LEAD5, _TAIL, _UPPER, _SMALL, _TEXT = np.arange(1, 8, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _feature(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (bytescan.mix(hashes ^ kind) >> np.uint64(44)).astype(np.int32)


def piece_features(p: bytescan.Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, feature) arrays of a piece, repeats included."""
    a, b = p.runs(p.kind == bytescan.LETTER)
    yield a, _feature(p.hashes(a, b), _WORD)
    for n, kind in ((4, _LEAD4), (5, _LEAD5)):
        a, b = a[b - a > n], b[b - a > n]
        yield a, _feature(p.hashes(a, a + n), kind)
    a, b = p.starts, p.ends
    # marks at the end of a chunk, two or more
    at = np.flatnonzero((p.kind[b - 1] == bytescan.MARK) & (b - a > 1)) if len(a) else np.zeros(0, int)
    at = at[p.kind[b[at] - 2] == bytescan.MARK]
    if len(at):
        begin, end = p.runs(p.kind == bytescan.MARK)
        first = begin[np.searchsorted(end, b[at])]
        yield a[at], _feature(p.hashes(first, np.minimum(first + 4, b[at])), _TAIL)
    shown = capitals(p)
    shown = shown[b[shown] - a[shown] > 2]
    yield a[shown], np.full(len(shown), _feature(np.zeros(1, np.uint64), _UPPER)[0], np.int32)
    at = np.flatnonzero(b - a <= 2)
    at = at[(p.kind[a[at]] == bytescan.MARK) & (p.kind[b[at] - 1] == bytescan.MARK)]
    yield a[at], _feature(p.hashes(a[at], b[at]), _SMALL)


def capitals(p: bytescan.Piece) -> np.ndarray:
    """The chunks that have a capital letter and no small one."""
    if not len(p.starts):
        return np.zeros(0, int)
    small = np.zeros(len(p.flat) + 1, np.int32)
    np.cumsum(p.lower, out=small[1:])
    at = np.flatnonzero(small[p.ends] == small[p.starts])
    big = np.flatnonzero(p.upper)
    return at[np.searchsorted(big, p.ends[at]) > np.searchsorted(big, p.starts[at])]


def text_features(chunks: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Two features of each text as a whole: tenths of its distinct chunks, and these with its size class."""
    tenth = np.where(chunks > 0, 10 * distinct // np.maximum(chunks, 1), 11)
    size = np.minimum(6, np.frexp(chunks.astype(float))[1] // 2)
    return np.stack([_feature(tenth.astype(np.uint64), _TEXT), _feature((tenth * 16 + size + 1024).astype(np.uint64), _TEXT)], axis=1)


def features(column, known: np.ndarray | None = None, watch=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each text of an Arrow column, each pair once, in order; known: a table of the features to look for.

    watch is called with every piece, the places of its chunks' hashes and these, and may count more on the same pass.
    """
    n = len(column)
    chunks, distinct = np.zeros(n, np.int64), bytescan.Distinct(n)
    keys = [np.zeros(0, np.int64)]
    for p in bytescan.pieces(column):
        marks = p.hashes(p.starts, p.ends)
        chunks[p.rows] += p.per_segment(p.starts)
        distinct.add(p, p.starts, marks)
        if watch:
            watch(p, marks)
        for place, feature in piece_features(p):
            if known is not None:
                hit = known[feature]
                place, feature = place[hit], feature[hit]
            keys.append(np.unique(p.rows[p.segment(place)] * DIMENSIONS + feature))
    whole = text_features(chunks, distinct.counts)
    row = np.repeat(np.arange(n), 2)
    hit = known[whole].ravel() if known is not None else np.ones(2 * n, bool)
    keys.append(row[hit] * DIMENSIONS + whole.ravel()[hit])
    key = np.unique(np.concatenate(keys))
    return key // DIMENSIONS, key % DIMENSIONS


class Sparse:
    """Documents as rows of feature numbers."""

    def __init__(self, rows: list[np.ndarray]):
        self.ends = np.cumsum([len(r) for r in rows])
        self.cols = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n = len(rows)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.cols], self.n)

    def transposed(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.cols, v[self.row], size)


def pick(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Features whose document frequency differs between soft classes ``y``, strongest first."""
    total, positive = np.bincount(x.cols, minlength=DIMENSIONS).astype(float), x.transposed(y, DIMENSIONS)
    share = y.mean() if len(y) else 0.0
    if not 0 < share < 1:
        return np.zeros(0, np.int64)
    expected = total * share
    chi = (positive - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - total / max(1, x.n)), 1e-9)
    chi[(total < MIN_DOCS) | (total >= x.n)] = 0
    best = np.argsort(-chi, kind="stable")[:WEIGHTS]
    return best[chi[best] >= MIN_CHI]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Model:
    """Logistic model: ``weights`` over hashed features, ``dense`` over further columns, ``bias``."""

    def __init__(self, weights: dict[int, float], dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """Of rows of feature numbers, without the dense part."""
        w = np.zeros(DIMENSIONS)
        w[list(self.weights)] = list(self.weights.values())
        return self.bias + Sparse(rows).times(w)


class Scorer:
    """Scores batches: of all features only those are kept that some model weighs."""

    def __init__(self, models: list[Model]):
        self.bias = np.array([m.bias for m in models])
        self.known = np.zeros(DIMENSIONS, bool)
        self.table = np.array(sorted(set().union(*(m.weights for m in models))), np.int64)
        self.known[self.table] = True
        self.weights = np.array([[m.weights.get(f, 0.0) for f in self.table.tolist()] for m in models]).reshape(len(models), -1)

    def logits(self, column, watch=None) -> np.ndarray:
        """A row for each text of an Arrow column: the logit of each model, without its dense part."""
        row, feature = features(column, self.known, watch)
        place = np.searchsorted(self.table, feature)
        return np.stack([b + np.bincount(row, w[place], len(column)) for b, w in zip(self.bias, self.weights, strict=True)], axis=1)


def fit(rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray | None = None, steps: int = 400, rate: float = 0.15, ridge: float = 1e-5) -> Model:
    """Adam over the whole sample on the ridge-penalised logistic loss of soft classes ``y``, features picked first."""
    extra = np.zeros((len(rows), 0)) if extra is None else extra
    full = Sparse(rows)
    chosen = pick(full, y)
    k, e = len(chosen), extra.shape[1]
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(k + e + 1)
    w[-1] = np.log(share / (1 - share))
    if not full.n:
        return Model({}, w[k:-1], float(w[-1]))
    place = np.full(DIMENSIONS, -1, np.int32)
    place[chosen] = np.arange(k)
    kept = place[full.cols] >= 0
    row, col = full.row[kept], place[full.cols[kept]]
    by_col = np.argsort(col, kind="stable")
    rows_of, cols_of = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(col[by_col], prepend=-1))
    some, picked, row_of_col = row[rows_of], col[by_col][cols_of], row[by_col]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = extra @ w[k : k + e] + w[-1]
        z[some] += np.add.reduceat(w[col], rows_of) if len(col) else 0
        miss = sigmoid(z) - y
        g = np.zeros_like(w)
        g[picked] = np.add.reduceat(miss[row_of_col], cols_of) if len(col) else 0
        g[k : k + e], g[-1] = extra.T @ miss, miss.sum()
        g /= full.n
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(dict(zip(chosen.tolist(), w[:k].tolist(), strict=True)), w[k : k + e], float(w[-1]))
