import numpy as np
import pytest

from rasterloom import __main__, api
from rasterloom.functions import pnm
from rasterloom.streaming import ingest


def test_stream_encodes_each_file_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    pixels = {f"a{k}": np.random.default_rng(k).integers(0, 256, (3, 4, 3)).astype(np.uint8) for k in range(3)}
    for name, a in pixels.items():
        (source / f"{name}.ppm").write_bytes(pnm.write(a.tobytes(), 4, 3, 8, 3))
    (source / "bad.ppm").write_bytes(b"P6\n1 1\n255\n")
    for _ in range(2):
        q = ingest.encode_stream(spark, str(source), str(target), str(tmp_path / "mark"), use_rle=True, available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None
    back = {r.path.rsplit("/", 1)[1]: bytes(r.pixels) for r in api.read(spark, str(target)).collect()}
    assert back == {f"{n}.rlc": a.tobytes() for n, a in pixels.items()}
    assert [r.reason for r in spark.read.json(f"{target}/_errors/*").collect()] == ["short_raster"]


def test_trees_keep_their_folders(spark, tmp_path):
    source = tmp_path / "in"
    for k, folder in enumerate(("a", "b/c")):
        (source / folder).mkdir(parents=True)
        (source / folder / "x.pgm").write_bytes(pnm.write(bytes([k] * 6), 3, 2, 8, 1))
    (source / "b" / "bad.pgm").write_bytes(b"P5\n")
    assert __main__.main(["compress", str(source), str(tmp_path / "c")]) == 1
    assert sorted(str(f.relative_to(tmp_path / "c")) for f in (tmp_path / "c").rglob("*.rlc")) == ["a/x.rlc", "b/c/x.rlc"]
    assert __main__.main(["decompress", str(tmp_path / "c"), str(tmp_path / "d")]) == 0
    assert (tmp_path / "d/a/x.pnm").read_bytes() != (tmp_path / "d/b/c/x.pnm").read_bytes()
    q = ingest.encode_stream(spark, str(source), str(tmp_path / "s"), str(tmp_path / "mark"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    assert sorted(str(f.relative_to(tmp_path / "s")) for f in (tmp_path / "s").rglob("*.rlc")) == ["a/x.rlc", "b/c/x.rlc"]
    (source / "a" / "x.ppm").write_bytes(pnm.write(bytes(18), 3, 2, 8, 3))  # both would become a/x.rlc
    with pytest.raises(Exception, match="twice"):
        api.encode_tree(spark, str(source), str(tmp_path / "e"), pictures_too=False)


def test_command_line(spark, tmp_path):
    (tmp_path / "x.pgm").write_bytes(pnm.write(bytes(range(6)), 3, 2, 8, 1))
    assert __main__.main(["compress-palette", str(tmp_path), str(tmp_path / "c")]) == 0
    assert __main__.main(["decompress", str(tmp_path / "c"), str(tmp_path / "d")]) == 0
    assert (tmp_path / "d" / "x.pnm").read_bytes() == (tmp_path / "x.pgm").read_bytes()
    assert __main__.main(["info", str(tmp_path / "c")]) == 0
    (tmp_path / "c" / "bad.rlc").write_bytes(b"1234")
    assert __main__.main(["info", str(tmp_path / "c")]) == 1
    assert __main__.main(["nothing"]) == 1
