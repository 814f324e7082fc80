"""Sharding, mixing, packing, token files."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, no_documents, odd_documents, prose
from pyspark.sql import functions as F

from rasterloom.llm import bytescan, mixing, packing, planes, sharding, tokens
from rasterloom.llm.prefix import starts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(spark):
    docs = odd_documents(spark)
    got = sharding.shard(spark, docs, bucket_rows=4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard(spark, docs, bucket_rows=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shard(spark, no_documents(spark)).collect() == []


def test_shards_are_shuffled_and_written(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('t', id) as text")
    rows = sharding.shard(spark, docs, bucket_rows=500).collect()
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(4000))[0, 1]) < 0.1
    sharding.write_shards(spark, docs, str(tmp_path / "out"), shards=4, bucket_rows=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("record.text").distinct().count() == 4000


def test_starts(spark):
    n = [random.Random(k).randrange(50) for k in range(300)]
    got = starts(spark.createDataFrame(list(enumerate(n)), "k int, n long"), "k", "n", group=7).collect()
    assert {r.k: r.start for r in got} == {k: sum(n[:k]) for k in range(300)}


def test_one_id_for_a_third_of_the_rows(spark):
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'same' as text")
    n = Counter(r.shard for r in sharding.shard(spark, docs, bucket_rows=100).collect())
    assert max(n.values()) - min(n.values()) <= 1


def shares(sizes, weights, total):
    """Water filling by repetition."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w >= 2 * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_water_fill(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got, want = mixing.water_fill(sizes, weights, 1.5 * sum(sizes), 2), shares(sizes, weights, 1.5 * sum(sizes))
    assert got == pytest.approx(want)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mix(spark):
    docs = odd_documents(spark)
    rows = mixing.mix_rows(mixing.mix_plan(spark, docs, slice_rows=2)).collect()
    assert len(rows) == len(ROWS)
    size = Counter()
    for _, t, _, s in ROWS:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, shares([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values())), strict=True))
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in size)
    again = mixing.mix_rows(mixing.mix_plan(spark, docs.repartition(7), slice_rows=2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_rows(mixing.mix_plan(spark, no_documents(spark))).collect() == []


def test_more_sources_than_the_driver_takes(spark, monkeypatch):
    """Targets by a table of sources are those that the driver finds."""
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 37 as int)) as text", "case when id % 41 = 0 then null else concat('s', id % 41) end as source")
    plain = sorted(map(str, mixing.mix_rows(mixing.mix_plan(spark, docs)).select("doc_id", "source_size", "taken", F.round("target", 6).alias("target")).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 5)
    got = mixing.mix_rows(mixing.mix_plan(spark, docs)).select("doc_id", "source_size", "taken", F.round("target", 6).alias("target")).collect()
    assert sorted(map(str, got)) == plain


def test_mix_gives_the_words_it_plans(spark):
    docs = odd_documents(spark)
    out = mixing.mix(spark, docs, ordered=True)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(spark, docs).collect()))
    words = Counter()
    for r in out.collect():
        words[r.source] += len(WORD.findall(r.text))
    plan = Counter()
    for r in mixing.mix_rows(mixing.mix_plan(spark, docs)).collect():
        plan[r.source] += r.taken
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}
    assert mixing.mix(spark, no_documents(spark)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=9), st.sampled_from([16, 64]), st.sampled_from([2, 5]), st.randoms())
def test_schedule(sizes, length, block, rnd):
    plan = packing.Schedule(sizes, length, block)
    total, seen = sum(sizes), set()
    given_by = Counter()
    for q, size in enumerate(sizes):
        at = 0
        while at < size:
            n = min(size - at, rnd.randrange(1, 400))
            lengths, windows, offsets = plan.pieces(q, at, n)
            assert lengths.sum() == n
            for a, w, o in zip(lengths.tolist(), windows.tolist(), offsets.tolist(), strict=True):
                seen.update(range(w * length + o, w * length + o + a))
                given_by[q, w] += a
            at += n
    assert seen == set(range(total))
    # every full window holds each source's share, up to what is owed
    for q, size in enumerate(sizes):
        for w in range(total // length):
            assert abs(given_by[q, w] - length * size / total) <= len(sizes) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.sampled_from([16, 64]), st.randoms())
def test_weighted_phases(sizes, length, rnd):
    weights = [rnd.choice((0, 1, 1, 2, 3.5)) for _ in sizes]
    plan = packing.Phases(sizes, weights, length, 3)
    seen, given_by = Counter(), Counter()
    for q, size in enumerate(sizes):
        at = 0
        while at < size:
            n = min(size - at, rnd.randrange(1, 400))
            lengths, windows, offsets = plan.pieces(q, at, n)
            assert lengths.sum() == n and (lengths > 0).all() and (offsets + lengths <= length).all()
            for a, w, o in zip(lengths.tolist(), windows.tolist(), offsets.tolist(), strict=True):
                seen.update(range(w * length + o, w * length + o + a))
                given_by[q, w] += a
            at += n
    assert seen == Counter(range(sum(sizes)))  # every place once
    active = [q for q in range(len(sizes)) if sizes[q] and weights[q]]
    for w in range(plan.starts[1] // length if active and len(plan.starts) > 1 else 0):  # until the first queue runs dry
        for q in active:
            assert abs(given_by[q, w] - length * weights[q] / sum(weights[k] for k in active)) <= len(sizes) + 2


def test_more_sources_than_queues(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id as doc_id", "concat('text number ', id) as text", "concat('s', id % 150) as source")
    monkeypatch.setattr(packing, "QUEUES", 20)
    monkeypatch.setattr(packing, "SHARED", 3)
    for weights in (None, {"s1": 5.0, "s2": 0.0}):
        rows = packing.pack(spark, docs, length=64, weights=weights).collect()
        place, got = Counter(), Counter()
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == place[r.sequence_id]
            place[r.sequence_id] += r.length
            got[r.doc_id] += r.length
        assert got == {d: len(ids_of(f"text number {d}")) for d in range(600)}
        assert all(place[s] == 64 for s in range(max(place)))


def ids_of(text):
    t = tokens.encoder(tokens.vocabulary()).tokenizer
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_pack(spark):
    rows = packing.pack(spark, odd_documents(spark), with_ids=True).collect()
    place = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place[r.sequence_id] and r.length > 0
        place[r.sequence_id] += r.length
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert all(place[s] == 2048 for s in range(max(place))) and place[max(place)] <= 2048
    want, got = Counter(), Counter()
    for d, t, _, _ in ROWS:
        want[d] += len(ids_of(t))
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    single = [r for r in rows if r.doc_id == 2]
    assert b"".join(bytes(r.ids) for r in sorted(single, key=lambda r: r.start)) == ids_of(ROWS[4][1]).tobytes()
    for parts in (1, 9):  # however the rows lie
        again = packing.pack(spark, odd_documents(spark).repartition(parts)).collect()
        seen = Counter((r.sequence_id, r.offset + k) for r in again for k in range(r.length))
        assert set(seen.values()) == {1} and len(seen) == sum(want.values())
    assert packing.pack(spark, no_documents(spark)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB ßÉ.,!'sİΣσςé́가ªµ\x1c\x85\xa0　\n\t1２Ñ日本<|>"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_units_encode_like_the_whole(text):
    assert encoded(tokens.encoder(tokens.vocabulary()), [text, None, text + " " + text]) == [ids_of(t).tolist() for t in (text, None, text + " " + text)]


def encoded(e, texts):
    ids, ends = e.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_special_tokens_and_a_small_memory():
    e = tokens.Encoder(tokens.vocabulary(), place_bits=2, room=8)
    texts = ["a <|endoftext|>b <|ENDOFTEXT|> c", "x y z w v u, x. y", "don't I'LL", prose(1, 300), "J\u030c j\u030c", "x" * 200 + " " + "é" * 90]
    for _ in range(3):
        assert encoded(e, texts) == [ids_of(t).tolist() for t in texts]


def test_very_long_texts_encode_like_the_whole(monkeypatch):
    """Texts longer than a piece, with white space or without."""
    monkeypatch.setattr(bytescan, "PIECE", 64)
    monkeypatch.setattr(bytescan, "_powers", [])
    monkeypatch.setattr(bytescan.pieces, "__defaults__", (64,))
    texts = [prose(2, 100), "short", "ab12-" * 60 + " end", prose(3, 5) + "\n" + "y" * 150, None]
    e = tokens.Encoder(tokens.vocabulary())
    assert encoded(e, texts) == [ids_of(t).tolist() for t in texts]
    assert encoded(e, texts[::-1]) == [ids_of(t).tolist() for t in texts[::-1]]


def test_a_vocabulary_of_unknown_rules():
    e = tokens.Encoder(tokens.vocabulary())
    e.by_unit = False
    texts = ["one two", None, "", prose(1, 40)]
    assert encoded(e, texts) == [ids_of(t).tolist() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=8), st.sampled_from([8, 1]), st.sampled_from([1, 8, 64]))
def test_plane_files_round_trip(docs, width, block):
    image = planes.write_segment([None if k % 3 == 2 else k for k in range(len(docs))], [np.array(d, "<u4") for d in docs], width, block)
    seg = planes.Segment(image)
    flat = [x for d in docs for x in d]
    assert seg.ids().tolist() == flat
    assert seg.counts.tolist() == [len(d) for d in docs]
    for _ in range(3):
        a = random.randrange(len(flat) + 1)
        assert seg.ids(a, 5).tolist() == flat[a : a + 5]


def test_damaged_plane_file():
    image = bytearray(planes.write_segment([1], [np.arange(1000, dtype="<u4")]))
    with pytest.raises(ValueError):
        planes.Segment(bytes(image[:-1]))


def test_exported_files(spark, tmp_path):
    segments = planes.write_ids(spark, odd_documents(spark), segment_ids=500, width=1)
    files = planes.export_files(spark, segments, str(tmp_path / "out")).collect()
    found = sorted((tmp_path / "out").iterdir())
    assert [str(f) for f in found] == sorted(r.path for r in files) and len(found) > 3
    read = [planes.Segment(f.read_bytes()) for f in found]
    docs = [(d, ids.tolist()) for s in read for d, ids in zip(s.doc_ids, np.split(s.ids(), np.cumsum(s.counts)[:-1]), strict=True)]
    assert Counter((d, tuple(x)) for d, x in docs) == Counter((d, tuple(ids_of(t).tolist())) for d, t, _, _ in ROWS)
    assert [d for d, _ in docs if d is not None] == sorted(d for d, _ in docs if d is not None)


def test_token_files(spark):
    segments = planes.write_ids(spark, odd_documents(spark), segment_ids=500)
    rows = planes.read_documents(spark, segments).orderBy("start").collect()
    assert len(rows) == len(ROWS)
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and [r.doc_id for r in rows[:2]] == [None, None]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(ids_of(t)), zlib.crc32(ids_of(t))) for d, t, _, _ in ROWS)
    assert planes.read_documents(spark, planes.write_ids(spark, no_documents(spark))).collect() == []
