import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom import api
from rasterloom.functions import container, kernels, pnm
from rasterloom.plans.catalog import DAMAGE, damaged

GOLDEN = {b"": 0x13D8AC5E, b"abc": 0x7DF17E77, b"abcd": 0x51104937, bytes(range(256)): 0x9D07CBDE, bytes(12): 0xC7D08FE6}


@pytest.mark.parametrize("raw", GOLDEN)
def test_golden_checksums(raw):
    assert kernels.checksum(raw) == GOLDEN[raw]


def folded(raw):
    h = list(kernels.LANE_START)
    for i, b in enumerate(raw):
        h[i % 4] = (h[i % 4] ^ b) * kernels.LANE_FACTOR[i % 4] & 0xFFFFFFFF
    return ((h[0] ^ (h[1] >> 3)) + (h[2] ^ (h[3] << 5 & 0xFFFFFFFF))) & 0xFFFFFFFF


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_checksum_is_the_fold(raw):
    assert kernels.checksum(raw) == folded(raw)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=12))
def test_checksums_at_once_are_those_of_each(parts):
    assert kernels.checksums(parts) == [folded(p) for p in parts]


def test_many_at_once():
    sound = container.encode(bytes(range(12)), 2, 2, 8, 3, 7)
    found = container.decode_many([sound, None, b"1234567", damaged(sound, "checksum"), sound])
    assert [x.reason if isinstance(x, container.Damaged) else x.pixels for x in found] == [bytes(range(12)), "too_small", "bad_size", "checksum", bytes(range(12))]
    made = container.encode_many([(bytes(range(12)), 2, 2, 8, 3, 7), (b"1", 2, 2, 8, 1, 1), (bytes(9), 1, 1, 8, 9, 5)])
    assert made[0] == sound and all(isinstance(x, ValueError) for x in made[1:])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 4), st.sampled_from([8, 16]), st.sampled_from([1, 3, 5, 7, 1 | 2 | 4 | 8]), st.randoms())
def test_round_trip(w, h, c, bpp, flags, rnd):
    raw = bytes(rnd.choice((0, 1, 127, 128, 254, 255, rnd.randrange(256))) for _ in range(w * h * c * bpp // 8))
    image = container.decode(container.encode(raw, w, h, bpp, c, flags))
    assert image.pixels == raw
    assert image[:7] == (w, h, bpp, c, 8, c * bpp // 8, flags)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 15, 16, 17, 31, 32, 33, 65_537])
def test_lengths_and_constant_images(n):
    for raw in (bytes(n), bytes(k % 256 for k in range(n))):
        assert container.decode(container.encode(raw, n, 1, 8, 1, 7)).pixels == raw


@pytest.mark.parametrize("kind", DAMAGE[1:])
def test_damage_is_told(kind):
    good = container.encode(bytes(range(200)), 20, 10, 8, 1, 7)
    with pytest.raises(container.Damaged) as e:
        container.decode(damaged(good, kind))
    assert e.value.reason == kind


def test_palette_faults():
    with pytest.raises(ValueError):
        container.encode(bytes(9), 1, 1, 8, 9, 5)
    with pytest.raises(ValueError):
        kernels.palette_apply(np.array([[3]], np.uint8), [np.array([1, 2], np.uint8)])
    with pytest.raises(ValueError):
        kernels.palette_parse(b"\x05\x01", 1)
    assert container.decode(None.__class__ and container.encode(b"\x01", 1, 1, 8, 1)).pixels == b"\x01"
    with pytest.raises(container.Damaged):
        container.decode(None)


@pytest.mark.parametrize("args", [(b"123", 2, 1, 8, 1), (b"", 0, 1, 8, 1), (b"12", 1, 1, 12, 1), (b"1", 1, 1, 8, 0)])
def test_guards(args):
    with pytest.raises(ValueError):
        container.encode(*args)


def test_sixteen_bit_steps():
    a = np.array([0x00FF, 0x0100, 0x00FF, 0xFFFF, 0], np.uint16)
    assert (kernels.merge16(kernels.split16(a)) == a).all()
    row = api.from_array(a.reshape(1, 5))
    assert (api.to_array(row | {"channels": 1}) == a.reshape(1, 5)).all()


@pytest.mark.parametrize("bad", [np.zeros(3, np.uint8), np.zeros((2, 2), np.float32), np.zeros((2, 2), ">u2")])
def test_arrays_refused(bad):
    if bad.dtype == np.dtype(">u2"):
        assert api.from_array(bad.astype(np.uint16))["bpp"] == 16
    else:
        with pytest.raises(ValueError):
            api.from_array(bad)


def test_header_alone_needs_no_pixels():
    data = container.encode(bytes(50_000), 50_000, 1, 8, 1, 3)
    assert container.peek(data)["width"] == 50_000
    assert container.peek(data) == container.header_of(container.payload(data))


@pytest.mark.parametrize(("data", "reason"), [(None, "magic"), (b"P5\n1 1\n255\n", "short_raster"), (b"P3\n1 1\n255\n1", "magic"), (b"P6\n1 1\n127\n123", "maxval"), (b"P5\n\n", "header")])
def test_bad_anymaps(data, reason):
    with pytest.raises(pnm.BadPnm) as e:
        pnm.parse(data)
    assert e.value.reason == reason


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([1, 3]), st.sampled_from([8, 16]), st.integers(1, 5), st.integers(1, 5), st.randoms())
def test_anymap_round_trip(c, bpp, w, h, rnd):
    raw = bytes(rnd.choice((0x20, 0x0A, 0x23, 1)) for _ in range(w * h * c * bpp // 8))
    assert pnm.parse(pnm.write(raw, w, h, bpp, c))[:4] + (pnm.parse(pnm.write(raw, w, h, bpp, c)).pixels,) == (w, h, bpp, c, raw)


def test_anymap_refuses_two_channels():
    with pytest.raises(ValueError):
        pnm.write(b"12", 1, 1, 8, 2)
