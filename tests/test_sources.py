import numpy as np
import pytest

from rasterloom import api
from rasterloom.functions import arrow, container
from rasterloom.operators import collection as co
from rasterloom.operators import pixels as px
from rasterloom.sources.files import register


def image_rows(n=5, c=3):
    rng = np.random.default_rng(1)
    return [{"path": f"set/{k}.rlc", **api.from_array(rng.integers(0, 9, (4 + k, 6, c)).astype(np.uint8))} for k in range(n)]


def frame(spark, rows):
    cols = ("path", "width", "height", "bpp", "channels", "pixels")
    return spark.createDataFrame([tuple(bytearray(r[c]) if c == "pixels" else r[c] for c in cols) for r in rows], "path string, width long, height long, bpp int, channels int, pixels binary")


def test_write_read_info(spark, tmp_path):
    rows = image_rows()
    api.write(frame(spark, rows), str(tmp_path), use_palette=True, use_rle=True)
    back = {r.path.rsplit("/", 1)[1]: r for r in api.read(spark, str(tmp_path)).collect()}
    assert {k: bytes(v.pixels) for k, v in back.items()} == {r["path"][4:]: r["pixels"] for r in rows}
    assert all(v.configuration == 7 for v in back.values())
    full, quick = (sorted(map(tuple, api.info(spark, str(tmp_path), verify=v).collect())) for v in (True, False))
    assert full == quick
    assert not [f for f in tmp_path.rglob("_*") if f.is_file() and f.suffix != ".crc" and "SUCCESS" not in f.name]


def test_overwrite_and_clashing_paths(spark, tmp_path):
    rows = image_rows()
    api.write(frame(spark, rows), str(tmp_path))
    api.write(frame(spark, [rows[0] | {"path": "set/new.rlc"}]), str(tmp_path), overwrite=True)
    files = lambda: sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file())
    assert files() == ["set/new.rlc"]
    api.write(frame(spark, [rows[1] | {"path": "set/new.rlc"}]), str(tmp_path))  # a file that is there is replaced
    assert [bytes(r.pixels) for r in api.read(spark, str(tmp_path)).collect()] == [rows[1]["pixels"]]
    for bad, why in (([rows[0], rows[1] | {"path": rows[0]["path"]}], "twice"), ([rows[0] | {"path": "../x.rlc"}], "no path below"), ([rows[0], rows[1] | {"width": 1}], "dimensions")):
        with pytest.raises(Exception, match=why):
            api.write(frame(spark, bad), str(tmp_path))
        assert files() == ["set/new.rlc"] and not list(tmp_path.glob("_held*"))


def test_headers_from_a_prefix(spark, tmp_path):
    import io

    big = api.from_array(np.random.default_rng(0).integers(0, 256, (600, 900, 3)).astype(np.uint8))
    data = container.encode(**{k: v for k, v in big.items() if k != "pixels"}, pixels=big["pixels"])
    f = io.BytesIO(data)
    assert container.peek_stream(f.read) == container.peek(data) and f.tell() < 200_000 < len(data)
    for broken, why in ((b"", "too_small"), (data[:4], "too_small"), (data[:4] + b"junk" * 20, "zstd"), (b"\0" * 4 + data[4:], "bad_size"), (data[:30], "zstd")):
        with pytest.raises(container.Damaged) as e:
            container.peek_stream(io.BytesIO(broken).read)
        assert e.value.reason == why
    (tmp_path / "a.rlc").write_bytes(data)
    (tmp_path / "b.rlc").write_bytes(b"1234")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.reason) for r in api.info(spark, str(tmp_path), verify=False, direct=True).collect()}
    assert got == {"a.rlc": (900, None), "b.rlc": (None, "too_small")}


def test_images_stay_on_the_workers(spark, tmp_path):
    rows = image_rows()
    api.write(frame(spark, rows), str(tmp_path), use_rle=True)
    (tmp_path / "bad.rlc").write_bytes(b"1234")
    got = {r.path.rsplit("/", 1)[1]: (r.n, r.top, r.reason) for r in api.map_arrays(spark, str(tmp_path), lambda a: (a.size, int(a.max())), "n long, top int").collect()}
    assert got == {r["path"][4:]: (len(r["pixels"]), max(r["pixels"]), None) for r in rows} | {"bad.rlc": (None, None, "too_small")}


def test_paths_below_a_folder(spark, tmp_path):
    for name in ("a/x.pgm", "b/c/x.pgm"):
        (tmp_path / name).parent.mkdir(parents=True)
        (tmp_path / name).write_bytes(b"P5\n1 1\n255\n\x01")
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/a/.."):
        found = co.files(spark, root, recursive=True)
        assert sorted(r[0] for r in found.select(co.below(spark, found.path, root)).collect()) == ["a/x.pgm", "b/c/x.pgm"]
    one = co.files(spark, f"{tmp_path}/a/x.pgm")
    assert [r[0] for r in one.select(co.below(spark, one.path, f"{tmp_path}/a/x.pgm")).collect()] == ["x.pgm"]


def test_format_and_pushdown(spark, tmp_path):
    register(spark)
    api.write(frame(spark, image_rows()), str(tmp_path))
    df = spark.read.format("rasterloom").option("mode", "meta").load(str(tmp_path))
    assert df.count() == 5 and "pixels" not in df.columns
    one = df.where(df.path == f"{tmp_path}/set/2.rlc")
    assert [r.height for r in one.collect()] == [6]


def test_pnm_source(spark, tmp_path):
    register(spark)
    rows = [r | {"path": r["path"].replace("rlc", "pnm")} for r in image_rows()]
    frame(spark, rows).write.format("pnm").mode("append").save(str(tmp_path))
    back = spark.read.format("pnm").load(str(tmp_path)).collect()
    assert sorted(bytes(r.pixels) for r in back) == sorted(r["pixels"] for r in rows)


def test_damaged_files_are_rows_or_errors(spark, tmp_path):
    (tmp_path / "bad.rlc").write_bytes(b"\x01\x02")
    assert [r.reason for r in api.read(spark, str(tmp_path)).collect()] == ["too_small"]
    with pytest.raises(Exception, match="too_small"):
        api.read(spark, str(tmp_path), strict=True).select("reason").collect()


def test_sql_functions(spark):
    arrow.register(spark)
    data = container.encode(bytes([1, 2, 3, 4]), 2, 2, 8, 1, 3)
    spark.createDataFrame([(bytearray(data),)], "content binary").createOrReplaceTempView("c")
    assert spark.sql("select rl_decode(content).pixels from c").first()[0] == bytearray([1, 2, 3, 4])
    assert spark.sql("select rl_info(content).width from c").first()[0] == 2
    assert spark.sql("select rl_checksum(cast('abc' as binary)) from c").first()[0] == 0x7DF17E77
    assert [tuple(r) for r in spark.sql("select p.* from c, lateral rl_pixels(c.content) p order by i").collect()] == [(0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 0, 4)]


def test_blocks_carry(spark, monkeypatch):
    monkeypatch.setattr(px, "BLOCK", 7)
    v = [(0, i, 0, (i * 37) % 256) for i in range(50)]
    df = spark.createDataFrame(v, "image_id long, i long, ch int, v int")
    d = {r.i: r.d for r in px.delta(df).collect()}
    assert all(d[i] == (v[i][3] - (v[i - 1][3] if i else 0)) % 256 for i in range(50))
    back = {r.i: r.v for r in px.prefix_sum(px.delta(df)).collect()}
    assert back == {x[1]: x[3] for x in v}


def test_empty_statistics(spark):
    none = spark.createDataFrame([], "a double")
    assert tuple(none.agg(*co.ratio_stats(none.a)).first()) == (0.0, 0.0, 0.0, 0.0)
    assert none.agg(*co.size_totals(none.a, none.a)).first().ratio == float("inf")
