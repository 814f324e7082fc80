"""HyperMinHash sketches of shingle sets.

A sketch has :data:`REGISTERS` buckets. A shingle's 64-bit hash falls into a bucket
by its leading bits, as one part in REGISTERS of the hash range; the least hash of
a bucket is kept as a floating-point byte: four bits for the number of leading
zeros and the four mantissa bits after the leading one. Buckets that no shingle
fell into borrow from another by a fixed seeded probing, so that small sets have
full sketches and two registers still agree with the probability of the sets'
Jaccard similarity. On top of that come chance collisions of the compressed
registers, whose rate follows from the two set sizes and which
:func:`corrected` takes out of the share of equal registers.
"""

from __future__ import annotations

import numpy as np

REGISTERS = 256
#: Bands times rows; a band is a bucket key of the near-duplicate search.
BANDS, ROWS = 32, 6
_ZEROS, _MANTISSA = 15, 4
_PROBES = 64

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


_EDGES = np.array([-(-i * (1 << 64) // REGISTERS) for i in range(REGISTERS)], np.uint64)
_PROBE = np.random.default_rng(7).integers(0, REGISTERS, (_PROBES, REGISTERS))
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _P[2]) | np.uint64(1)
_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _P[0]) | np.uint64(1)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _P[1])


def shingles(text: bytes | None, words: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of all its words as one if they are fewer."""
    from xxhash import xxh3_64_digest

    found = text.lower().split() if text else []  # both of ASCII only, on bytes
    if not found:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxh3_64_digest, found)), np.uint64)
    if len(h) < words:
        return mix((h * _PLACE[: len(h)]).sum(dtype=np.uint64, keepdims=True) ^ _PLACE[-len(h)])
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers (uint8) of a non-empty sorted set of hashes."""
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.append(at[1:], len(hashes))
    least = (hashes[at[filled]] - _EDGES[filled]) * np.uint64(REGISTERS)
    mantissa, exponent = np.frexp((least.astype(np.float64) + 0.5) / 2.0**64)
    zeros = np.minimum(-exponent, _ZEROS)
    cell = np.ldexp(mantissa, zeros + exponent + _MANTISSA + (zeros < _ZEROS)).astype(np.int64) & 15
    out = np.zeros(REGISTERS, np.uint8)
    out[filled] = (zeros << 4) | cell
    if not filled.all():
        full = filled.copy()
        given = out.copy()
        for probe in _PROBE:
            take = ~full & filled[probe]
            out[take] = given[probe[take]]
            full |= take
            if full.all():
                break
        else:
            places = np.flatnonzero(filled)
            rest = np.flatnonzero(~full)
            out[rest] = given[places[np.searchsorted(places, rest) % len(places)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the compressed registers."""
    rows = registers[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)
    return mix((rows * _WEIGHTS).sum(axis=1, dtype=np.uint64) ^ _BAND_SEEDS).view(np.int64)


def _cells() -> np.ndarray:
    """Lower edges, in the bucket's unit range, of the 256 register values in order of value."""
    zeros, part = np.divmod(np.arange(256), 16)
    low = np.ldexp(1.0 + part / 16, -zeros - 1)
    width = np.ldexp(1.0, -zeros - 5)
    last = zeros == _ZEROS
    low[last], width[last] = part[last] / 16 * 2.0**-_ZEROS, 2.0**-_ZEROS / 16
    return np.stack([low, low + width])


_CELLS = _cells()


def cell_odds(size: np.ndarray) -> np.ndarray:
    """For sets of the sizes given: the chance of each register value."""
    rate = np.maximum(size, 1)[:, None] / REGISTERS
    odds = np.exp(-rate * _CELLS[0]) - np.exp(-rate * _CELLS[1])
    return odds / odds.sum(axis=1, keepdims=True)


def corrected(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from numbers of equal registers, without the chance collisions expected at these sizes."""
    chance = (cell_odds(size_a) * cell_odds(size_b)).sum(axis=1)
    return (equal / REGISTERS - chance) / (1 - chance)
