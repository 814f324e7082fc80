"""The raster container: a size word, then one zstd frame of header, palette and samples.

    uint32 payload size | zstd( 10 x uint32 header | palette | interleaved bytes )

All words are little-endian. The header holds magic, bits per sample and channels
as the caller sees them, width, height, the same two as stored (16-bit samples are
two byte channels), the checksum of the stored bytes, the configuration bits and the
size of the palette.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from rasterloom.functions import kernels as k

# Fixed values of the format.
MAGIC = 0x505A5030
USE_COMPRESSION, USE_DELTA, USE_PALETTE = 1, 2, 4
MAX_PAYLOAD = 100_000_000
MAX_PALETTE_CHANNELS = 8
LEVEL, LEVEL_WITH_PALETTE = 1, 19

HEADER = struct.Struct("<10I")
HEADER_FIELDS = ("magic", "bpp_ext", "channels_ext", "width", "height", "bpp_int", "channels_int", "checksum", "config", "palette_bytes")
#: Why a container is refused, in the order of the checks.
REASONS = ("too_small", "bad_size", "zstd", "size_mismatch", "magic", "bounds", "checksum", "palette", "palette_index")


class Damaged(ValueError):
    """A container that cannot be read; ``reason`` is one of :data:`REASONS`."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class Image(NamedTuple):
    width: int
    height: int
    bpp: int
    channels: int
    bpp_internal: int
    ch_internal: int
    configuration: int
    pixels: bytes | None


def check_image(size: int, width: int, height: int, bpp: int, channels: int) -> None:
    """ValueError unless ``size`` bytes are an image of these dimensions."""
    if not (width and height and channels and width > 0 and height > 0 and channels > 0):
        raise ValueError("width, height and channels must be positive")
    if bpp not in (8, 16):
        raise ValueError(f"bpp must be 8 or 16, not {bpp}")
    if size != width * height * channels * (bpp // 8):
        raise ValueError(f"{size} bytes, but the dimensions need {width * height * channels * (bpp // 8)}")


class _Coded(NamedTuple):
    """What :func:`encode` has made of an image before its checksum is known."""

    raw: bytes
    palette: bytes
    fields: tuple[int, int, int, int, int]
    configuration: int


def _code(pixels: bytes, width: int, height: int, bpp: int, channels: int, configuration: int) -> _Coded:
    check_image(len(pixels), width, height, bpp, channels)
    inner = channels * (bpp // 8)
    planes = k.as_planes(pixels, inner)
    palette = b""
    if configuration & USE_PALETTE:
        if inner > MAX_PALETTE_CHANNELS:
            raise ValueError(f"a palette holds at most {MAX_PALETTE_CHANNELS} byte channels, not {inner}")
        palettes, planes = k.palette_of(planes)
        palette = k.palette_bytes(palettes)
    if configuration & USE_DELTA:
        planes = k.delta(planes)
    raw = planes.tobytes()
    if HEADER.size + len(palette) + len(raw) > MAX_PAYLOAD:
        raise ValueError(f"payload of {HEADER.size + len(palette) + len(raw)} bytes is over {MAX_PAYLOAD}")
    return _Coded(raw, palette, (bpp, channels, width, height, inner), configuration)


def _pack(c: _Coded, checksum: int, level: int | None) -> bytes:
    import zstandard

    bpp, channels, width, height, inner = c.fields
    head = HEADER.pack(MAGIC, bpp, channels, width, height, 8, inner, checksum, c.configuration, len(c.palette))
    level = level if level is not None else LEVEL_WITH_PALETTE if c.configuration & USE_PALETTE else LEVEL
    body = head + c.palette + c.raw
    return struct.pack("<I", len(body)) + zstandard.ZstdCompressor(level=level).compress(body)


def encode(pixels: bytes, width: int, height: int, bpp: int, channels: int, configuration: int = USE_COMPRESSION, level: int | None = None) -> bytes:
    """Container bytes. 16-bit samples come as big-endian pairs."""
    coded = _code(pixels, width, height, bpp, channels, configuration)
    return _pack(coded, k.checksum(coded.raw), level)


def encode_many(images: list[tuple]) -> list[bytes | ValueError]:
    """:func:`encode` of each (pixels, width, height, bpp, channels, configuration); an image that is refused gives its error."""
    coded = [_or_error(ValueError, _code, *x) for x in images]
    sums = iter(k.checksums([c.raw for c in coded if isinstance(c, _Coded)]))
    return [_pack(c, next(sums), None) if isinstance(c, _Coded) else c for c in coded]


def _or_error(kind, f, *args):
    try:
        return f(*args)
    except kind as e:
        return e


def _declared(data: bytes | None) -> int:
    if data is None or len(data) <= 4:
        raise Damaged("too_small")
    (size,) = struct.unpack_from("<I", data)
    if not 0 < size <= MAX_PAYLOAD:
        raise Damaged("bad_size")
    return size


def weight(data: bytes | None) -> int:
    """Bytes of the payload that the container declares, 0 where it is not sound."""
    try:
        return _declared(data)
    except Damaged:
        return 0


def payload(data: bytes | None) -> bytes:
    """The decompressed payload, of exactly the declared size."""
    import zstandard

    size = _declared(data)
    frame = memoryview(data)[4:]
    try:
        told = zstandard.frame_content_size(frame)
        if told >= 0 and told != size:
            raise Damaged("size_mismatch")
        out = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size)
    except zstandard.ZstdError:
        raise Damaged("zstd") from None
    if len(out) != size:
        raise Damaged("size_mismatch")
    return out


def header_of(raw: bytes) -> dict[str, int]:
    if len(raw) < HEADER.size:
        raise Damaged("magic" if len(raw) < 4 or struct.unpack_from("<I", raw)[0] != MAGIC else "bounds")
    found = dict(zip(HEADER_FIELDS, HEADER.unpack_from(raw), strict=True))
    if found["magic"] != MAGIC:
        raise Damaged("magic")
    return found


def peek(data: bytes | None) -> dict[str, int]:
    """The header alone: decompresses its 40 bytes and verifies nothing behind them."""
    import zstandard

    _declared(data)
    try:
        with zstandard.ZstdDecompressor().stream_reader(memoryview(data)[4:]) as z:
            raw = z.read(HEADER.size)
    except zstandard.ZstdError:
        raise Damaged("zstd") from None
    return header_of(raw)


def peek_stream(read: Callable[[int], bytes], step: int = 16 << 10) -> dict[str, int]:
    """The header of a container that ``read(n)`` gives the bytes of, from as few of them as will do: the frame's first block at most."""
    import zstandard

    start = read(5)
    _declared(start)
    z = zstandard.ZstdDecompressor().decompressobj()
    try:
        raw = z.decompress(start[4:])
        while len(raw) < HEADER.size and (more := read(step)):
            raw += z.decompress(more)
    except zstandard.ZstdError:
        raise Damaged("zstd") from None
    if len(raw) < HEADER.size and not z.eof:
        raise Damaged("zstd")
    return header_of(raw)


class _Opened(NamedTuple):
    """A container whose checksum is not verified yet."""

    header: dict[str, int]
    samples: np.ndarray
    palette: bytes


def _open(data: bytes | None) -> _Opened:
    raw = payload(data)
    h = header_of(raw)
    count = h["width"] * h["height"] * h["channels_int"] * (h["bpp_int"] // 8)
    at = HEADER.size + h["palette_bytes"]
    if at + count > len(raw) or not h["channels_int"]:
        raise Damaged("bounds")
    return _Opened(h, np.frombuffer(raw, np.uint8, count, at), raw[HEADER.size : at])


def _image(o: _Opened, checksum: int, pixels: bool) -> Image:
    h = o.header
    if checksum != h["checksum"]:
        raise Damaged("checksum")
    shape = Image(h["width"], h["height"], h["bpp_ext"], h["channels_ext"], h["bpp_int"], h["channels_int"], h["config"], None)
    planes = o.samples.reshape(-1, h["channels_int"])
    if h["config"] & USE_PALETTE:
        if h["channels_int"] > MAX_PALETTE_CHANNELS:
            raise Damaged("palette")
        try:
            palettes = k.palette_parse(o.palette, h["channels_int"])
        except ValueError:
            raise Damaged("palette") from None
    if not pixels:
        return shape
    if h["config"] & USE_DELTA:
        planes = k.undelta(planes)
    if h["config"] & USE_PALETTE:
        try:
            planes = k.palette_apply(planes, palettes)
        except ValueError:
            raise Damaged("palette_index") from None
    return shape._replace(pixels=planes.tobytes())


def decode(data: bytes | None, *, pixels: bool = True) -> Image:
    """The image, verified; :class:`Damaged` tells what is wrong."""
    opened = _open(data)
    return _image(opened, k.checksum(opened.samples), pixels)


def decode_many(contents: list[bytes | None], *, pixels: bool = True) -> list[Image | Damaged]:
    """:func:`decode` of each, their checksums all at once; a container that cannot be read gives its error."""
    opened = [_or_error(Damaged, _open, c) for c in contents]
    sums = iter(k.checksums([o.samples for o in opened if isinstance(o, _Opened)]))
    return [_or_error(Damaged, _image, o, next(sums), pixels) if isinstance(o, _Opened) else o for o in opened]
