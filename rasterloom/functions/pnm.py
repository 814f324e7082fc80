"""Portable anymaps: P5 (one channel) and P6 (three), 8 or 16 bits, big-endian samples."""

from __future__ import annotations

import re
from typing import NamedTuple

_HEAD = re.compile(rb"(P[56])\n((?:#[^\n]*\n)*)[ \t\r\n]*(\d+)[ \t]+(\d+)[ \t\r\n]+(\d+)[ \t\r\n]")
_STAMP = re.compile(rb"^#TIMESTAMP[ \t]*([+-]?\d+)", re.M)
#: Largest sample values that are read, and their bits.
MAXVAL_BITS = {255: 8, 65535: 16}


class Pnm(NamedTuple):
    width: int
    height: int
    bpp: int
    channels: int
    timestamp: int | None
    pixels: bytes


class BadPnm(ValueError):
    """reason: magic, header, maxval or short_raster."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def parse(data: bytes | None) -> Pnm:
    """Exactly one white-space byte stands between the largest value and the raster."""
    if data is None or data[:3] not in (b"P5\n", b"P6\n"):
        raise BadPnm("magic")
    m = _HEAD.match(data)
    if not m:
        raise BadPnm("header")
    channels, width, height, top = 1 if m[1] == b"P5" else 3, int(m[3]), int(m[4]), int(m[5])
    bpp = MAXVAL_BITS.get(top)
    if bpp is None:
        raise BadPnm("maxval")
    size = width * height * channels * (bpp // 8)
    pixels = bytes(data[m.end() : m.end() + size])
    if len(pixels) < size or not size:
        raise BadPnm("short_raster")
    stamp = _STAMP.search(m[2])
    return Pnm(width, height, bpp, channels, int(stamp[1]) if stamp else None, pixels)


def write(pixels: bytes, width: int, height: int, bpp: int, channels: int) -> bytes:
    if channels not in (1, 3):
        raise ValueError(f"an anymap has 1 or 3 channels, not {channels}")
    if width <= 0 or height <= 0 or bpp not in (8, 16) or len(pixels) != width * height * channels * (bpp // 8):
        raise ValueError("the bytes do not fit the dimensions")
    return b"%s\n%d %d\n%d\n" % (b"P5" if channels == 1 else b"P6", width, height, (1 << bpp) - 1) + bytes(pixels)
