"""Chunks, words and lines of whole texts, found by array operations on UTF-8 bytes.

A batch of Arrow strings is walked in pieces of bounded size: runs of whole texts,
or slices of one long text. In a piece a running sum of weighted bytes gives the
hash of any span from its two ends, so that chunks (between white space), letter
runs, their leading bytes and lines are all hashed without a Python object for any
of them, and nothing is remembered from one piece to the next.

ASCII and Latin-1 letters are folded to lower case; other bytes from 128 on count as
letters. A text longer than a piece is cut after its last line end, else after its
last white space, else where the piece ends, so the cuts depend on the text alone;
what spans a cut counts on each side of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of a piece: its arrays take some 40 times that.
PIECE = 1 << 19
SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[128:] = LETTER
    return kinds


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_UPPER, _IS_LOWER = np.zeros(256, bool), np.zeros(256, bool)
_IS_UPPER[65:91], _IS_LOWER[97:123] = True, True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, for every place of a piece."""
    if not _powers:
        for b in (_BASE, _INVERSE):
            p = np.full(PIECE + 1, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


class Piece:
    """rows: the text that each segment is of, each text once; flat: all bytes; edges: where segments begin, and the end; cut: whether its end parts a chunk."""

    def __init__(self, rows: np.ndarray, flat: np.ndarray, edges: np.ndarray, cut: bool = False):
        self.rows, self.flat, self.edges, self.cut = rows, flat, edges, cut
        power, self._inverse = _tables()
        n = len(flat)
        self.kind = _KIND[flat]
        self.folded = folded = _LOWER[flat]
        self.upper, self.lower = _IS_UPPER[flat], _IS_LOWER[flat]
        lead = np.flatnonzero(flat == 0xC3)
        after = lead[lead + 1 < n] + 1
        second = flat[after]
        big = after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        folded[big] += 32
        self.upper[big] = True
        self.lower[after[(second >= 0x9F) & (second != 0xB7)]] = True
        self._power = power[:n]
        self._sum, self._raw_sum = self._running(folded), None
        solid = self.kind != SPACE
        self.starts, self.ends = self.runs(solid)

    def _running(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self._power, out=out[1:])
        return out

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each run of set bytes; a run ends with its segment."""
        begin, end = mask.copy(), mask.copy()
        if len(mask):
            begin[1:] &= ~mask[:-1]
            end[:-1] &= ~mask[1:]
            inner = self.edges[1:-1]
            inner = inner[inner < len(mask)]
            begin[inner] |= mask[inner]
            inner = inner[inner > 0]
            end[inner - 1] |= mask[inner - 1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the folded spans from a to b."""
        return (self._sum[b] - self._sum[a]) * self._inverse[a]

    def raw_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans as they stand, other than :meth:`hashes` has for any."""
        if self._raw_sum is None:
            self._raw_sum = self._running(self.flat)
        return ((self._raw_sum[b] - self._raw_sum[a]) * self._inverse[a]) ^ _M2

    def segment(self, places: np.ndarray) -> np.ndarray:
        """The segment of each byte."""
        return np.searchsorted(self.edges, places, "right") - 1

    def per_segment(self, places: np.ndarray) -> np.ndarray:
        """How many of the ascending places are in each segment."""
        return np.diff(np.searchsorted(places, self.edges))

    def count(self, *values: int) -> np.ndarray:
        """Bytes with one of the values, in each segment."""
        table = np.zeros(256, bool)
        table[list(values)] = True
        return self.per_segment(np.flatnonzero(table[self.flat]))


def pieces(column, most: int = PIECE) -> Iterator[Piece]:
    """The texts of an Arrow string or binary column; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        if j > i:
            yield Piece(np.arange(i, j), flat[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j
        else:
            for a, b in _slices(flat, int(at[i]), int(at[i + 1]), most):
                yield Piece(np.array([i]), flat[a:b], np.array([0, b - a]), b < at[i + 1] and _KIND[flat[b - 1]] != SPACE)
            i += 1


def _slices(flat: np.ndarray, a: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    while end - a > most:
        window = flat[a : a + most]
        for cut in (window == 10, _KIND[window] == SPACE):
            found = np.flatnonzero(cut)
            if len(found):
                b = a + int(found[-1]) + 1
                break
        else:
            b = a + most
        yield a, b
        a = b
    yield a, end


class Distinct:
    """Number of different hashes in each text, over all its pieces."""

    def __init__(self, n: int):
        self.counts = np.zeros(n, np.int64)
        self._last, self._seen = -1, np.zeros(0, np.uint64)

    def add(self, piece: Piece, places: np.ndarray, hashes: np.ndarray) -> None:
        if len(piece.rows) > 1:
            # the segment in the leading bits, the hash in the rest, so that one sort of numbers does
            bits = np.uint64(64 - len(piece.rows).bit_length())
            keys = np.sort((piece.segment(places).astype(np.uint64) << bits) | (mix(hashes) >> (np.uint64(64) - bits)))
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            self.counts[piece.rows] += np.bincount((keys[new] >> bits).astype(np.int64), minlength=len(piece.rows))
            return
        row = int(piece.rows[0])
        self._seen = np.unique(np.concatenate([self._seen, hashes])) if row == self._last else np.unique(hashes)
        self._last = row
        self.counts[row] = len(self._seen)
