"""Array kernels on raw sample bytes.

An image's samples are handled as a matrix of shape (pixels, channels) of bytes;
16-bit samples are two byte channels, high byte first. All kernels are whole-array
operations without a Python loop over pixels.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the checksum: start and multiplier of each of the four lanes.
LANE_START = (0x12345678, 0x9ABCDEF0, 0xFEDCBA98, 0x87654321)
LANE_FACTOR = (31, 37, 41, 43)
#: Bytes that checksums take at once, about.
GROUP_BYTES = 1 << 18


def as_planes(pixels: bytes | np.ndarray, channels: int) -> np.ndarray:
    """The samples as a (pixels, channels) view."""
    flat = np.frombuffer(pixels, np.uint8) if not isinstance(pixels, np.ndarray) else pixels
    return flat.reshape(-1, channels)


def split16(samples: np.ndarray) -> np.ndarray:
    """Big-endian byte pairs of 16-bit samples."""
    return np.ascontiguousarray(samples, ">u2").view(np.uint8)


def merge16(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u2").astype(np.uint16)


def palette_of(planes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each channel its values in ascending order, and every sample's rank among them."""
    ranks = np.empty_like(planes)
    palettes = []
    for c in range(planes.shape[1]):
        present = np.bincount(planes[:, c], minlength=256) > 0
        palettes.append(np.flatnonzero(present).astype(np.uint8))
        ranks[:, c] = (np.cumsum(present) - 1).astype(np.uint8)[planes[:, c]]
    return palettes, ranks


def palette_bytes(palettes: list[np.ndarray]) -> bytes:
    """Per channel the count less one, then the values."""
    return b"".join(bytes([len(p) - 1]) + p.tobytes() for p in palettes)


def palette_parse(raw: bytes, channels: int) -> list[np.ndarray]:
    """Inverse of :func:`palette_bytes`; ValueError if ``raw`` is too short."""
    out, at = [], 0
    for _ in range(channels):
        if at >= len(raw) or at + 2 + raw[at] > len(raw):
            raise ValueError("palette")
        out.append(np.frombuffer(raw, np.uint8, raw[at] + 1, at + 1))
        at += raw[at] + 2
    return out


def palette_apply(ranks: np.ndarray, palettes: list[np.ndarray]) -> np.ndarray:
    """Values of ranks; ValueError for a rank that its palette lacks."""
    out = np.empty_like(ranks)
    for c, p in enumerate(palettes):
        if len(ranks) and int(ranks[:, c].max()) >= len(p):
            raise ValueError("palette_index")
        out[:, c] = p[ranks[:, c]]
    return out


def delta(planes: np.ndarray) -> np.ndarray:
    """Each sample less the one before it in its channel, modulo 256; rows of the image do not matter."""
    out = planes.copy()
    out[1:] -= planes[:-1]
    return out


def undelta(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes, axis=0, dtype=np.uint8)


_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2**32 for k < n, by doubling; the longest one asked for is kept."""
    out = _powers.get(base)
    if out is None:
        out = np.ones(1, np.uint32)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint32(pow(base, len(out), 1 << 32))])
    _powers[base] = out
    return out[:n]


# The masks of an 8 x 8 bit transposition.
_SWAPS = ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0))


def _transpose_bits(x: np.ndarray) -> np.ndarray:
    """Each 64-bit word as 8 bytes of 8 bits, rows and columns swapped. Works on ``x`` itself."""
    for shift, mask in _SWAPS:
        t = x >> np.uint64(shift)
        t ^= x
        t &= np.uint64(mask)
        x ^= t
        t <<= np.uint64(shift)
        x ^= t
    return x


def _running_parity(words: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exclusive running XOR over bit sequences packed into 64-bit words, first bit lowest; each begins at a word of ``heads``."""
    x = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x << np.uint64(s)
    carry = np.bitwise_xor.accumulate(x >> np.uint64(63))
    before = np.zeros_like(carry)
    before[1:] = carry[:-1]
    if len(heads) > 1:
        before ^= np.repeat(before[heads], sizes)
    x ^= np.uint64(0) - before
    first = np.zeros_like(x)
    first[1:] = x[:-1] >> np.uint64(63)
    first[heads] = 0
    return (x << np.uint64(1)) | first


class _Layout:
    """Sequences of bytes behind each other, each padded to whole 64-bit words of every lane and bit."""

    def __init__(self, parts: list[np.ndarray]):
        self.lengths = np.array([len(p) for p in parts], np.int64)
        blocks = np.maximum(-(-self.lengths // 256), 1)
        ends = np.cumsum(blocks)
        self.heads, self.sizes = ends - blocks, blocks  # in words of a lane's bit line: 256 bytes are 64 of each lane
        self.data = np.zeros(256 * int(ends[-1]), np.uint8)
        for p, at in zip(parts, (256 * self.heads).tolist(), strict=True):
            self.data[at : at + len(p)] = p

    def lane(self, k: int, start: int, factor: int) -> np.ndarray:
        """State of lane k of each sequence after folding its bytes: state = (state ^ byte) * factor, modulo 2**32.

        The XOR touches the low byte only, and bit j of that byte's sequence is a
        running XOR of input bits and of carries from lower bits, so the low bytes come
        from eight running XORs over packed bits. With them known the rest is linear.
        """
        data = np.ascontiguousarray(self.data[k::4])
        inputs = np.ascontiguousarray(_transpose_bits(data.view("<u8").copy()).view(np.uint8).reshape(-1, 8).T).view("<u8")
        lines = np.empty_like(inputs)  # bits of the low byte before each step
        x: list[np.ndarray] = []  # bits of (low byte ^ input)
        # factor * x is a sum of shifted x: an adder for each shift, that holds its carry into the present bit
        shifts = [k for k in range(1, 8) if factor >> k & 1]
        carries = [np.zeros_like(inputs[0]) for _ in shifts]
        for j in range(8):
            terms = [x[j - k] if j >= k else None for k in shifts]
            drive = inputs[j].copy()
            for b, c in zip(terms, carries, strict=True):
                if b is not None:
                    drive ^= b
                drive ^= c
            line = _running_parity(drive, self.heads, self.sizes)
            lines[j] = ~line if start >> j & 1 else line
            x.append(lines[j] ^ inputs[j])
            total = x[j]
            for i, (b, c) in enumerate(zip(terms, carries, strict=True)):
                if b is None:  # no term: the carry only moves on into the total
                    carries[i], total = total & c, total ^ c
                else:
                    both = total ^ b
                    carries[i], total = (total & b) | (c & both), both ^ c
        low = _transpose_bits(np.ascontiguousarray(lines.view(np.uint8).T).view("<u8").reshape(-1)).view(np.uint8)
        change = ((low ^ data).astype(np.int16) - low).astype(np.int32).view(np.uint32)
        # state_n = factor**n * (start + sum of change_k * factor**-k)
        n = np.maximum(0, -(-(self.lengths - k) // 4))
        inverse = _powers_of(pow(factor, -1, 1 << 32), int(n.max(initial=1)) or 1)
        if len(n) == 1:
            sums = np.array([np.dot(change[: n[0]], inverse[: n[0]])], np.uint32)
        else:
            begin = 64 * self.heads
            place = np.arange(len(data)) - np.repeat(begin, 64 * self.sizes)
            counted = place < np.repeat(n, 64 * self.sizes)
            product = change * inverse[np.minimum(place, len(inverse) - 1)]
            product[~counted] = 0
            sums = np.add.reduceat(product, begin)
        return (sums + np.uint32(start)) * _powers_of(factor, int(n.max(initial=0)) + 1)[n]


def checksums(parts: list[bytes | np.ndarray]) -> list[int]:
    """The container's 32-bit checksum of each sequence: four lanes over bytes k, k+4, ..., folded together."""
    out: list[int] = []
    group: list[np.ndarray] = []
    size = 0
    for p in parts:  # in groups whose arrays stay in a processor's cache
        group.append(np.frombuffer(p, np.uint8) if not isinstance(p, np.ndarray) else p.reshape(-1))
        size += group[-1].size
        if size >= GROUP_BYTES:
            out += _checksums(group)
            group, size = [], 0
    return out + _checksums(group) if group else out


def _checksums(parts: list[np.ndarray]) -> list[int]:
    layout = _Layout(parts)
    h = [layout.lane(k, LANE_START[k], LANE_FACTOR[k]).astype(np.uint32) for k in range(4)]
    return ((h[0] ^ (h[1] >> np.uint32(3))) + (h[2] ^ (h[3] << np.uint32(5)))).tolist()


def checksum(raw: bytes | np.ndarray) -> int:
    return checksums([raw])[0]
