"""Each stage of the pipeline against a brute-force version, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rasterloom.llm import linear, mixing, quality, tokens, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).persist()
        out[name] = (docs, made)
        docs = made
    return out


def rows_of(df):
    return [(r.doc_id, r.text, r.source, r.lang) for r in df.collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "packing" or after.columns == before.columns


def test_toxicity_stage(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(spark, before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter()
    for row in rows_of(before):
        _, found = linear.features(pa.array([row[1]], pa.string()))
        done = []
        for m in model.models:
            z = m.bias + sum(m.weights.get(int(f), 0.0) for f in found) + sum(w * max(-8.0, min(8.0, d)) for w, d in zip(m.dense, done, strict=True))
            done.append(z)
        want[row] += 1 / (1 + np.exp(-done[-1])) < model.cutoffs[-1]
    assert Counter(rows_of(after)) == +want and sum(want.values()) > 0


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    measured = quality.measured(spark, before, "doc_id", "text", "lang")
    cuts = {r.stratum: r for r in quality.cutoffs(measured, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    want = Counter()
    for row in rows_of(before):
        text, lang = row[1] or "", row[3]
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        chars = sum(map(len, words))
        share = lambda a, b: min(1000, 1000 * a // b) if b else 0
        measures = {
            "symbols": share(len(re.findall(r"[#*$%&|<>]", text)), chars), "dup_lines": share(len(lines) - len(set(lines)), len(lines)), "repeats": share(len(again), len(words)),
            "capitals": share(sum(c.isupper() for c in text), chars), "shouts": share(text.count("!"), len(words)), "stutter": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
        }
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        cut = lang in cuts and any(cuts[lang][f"_q_cut_{r}"] is not None and v >= cuts[lang][f"_q_cut_{r}"] for r, v in measures.items())
        want[row] += not failed and not cut
    assert Counter(rows_of(after)) == +want


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]
    rows = rows_of(before)
    sets = []
    for _, text, *_ in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(w)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset({tuple(w)}) if w else frozenset()))
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    want = [r for r in rows if find(r[0]) == r[0]]
    assert Counter(rows_of(after)) == Counter(want) and len(want) < len(rows)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    rows = [(d, t, s, len(WORD.findall(t or ""))) for d, t, s, _ in rows_of(before)]
    size = Counter()
    for _, _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.water_fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    want, got = Counter(), Counter()
    for s in order:
        left = int(target[s])
        queue = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"mix-1/{r[0]}/{r[3]}".encode()).hexdigest(), r[0]))
        for _ in range(2):
            for d, text, _, n in queue:
                take = min(n, left)
                left -= take
                if take:
                    want[d, text if take == n else " ".join(WORD.findall(text)[:take])] += 1
    for d, text, _, _ in rows_of(after):
        got[d, text] += 1
    assert got == want


def test_packing_stage(stages):
    before, after = stages["packing"]
    library = tokens.encoder(tokens.vocabulary()).tokenizer
    want = defaultdict(list)
    for d, text, *_ in rows_of(before):
        want[d].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    place, pieces = Counter(), Counter()
    for r in sorted(after.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == place[r.sequence_id] and r.length > 0
        place[r.sequence_id] += r.length
        assert r.ids_crc32 in {zlib.crc32(ids[r.start : r.start + r.length]) for ids in want[r.doc_id] if len(ids) == r.doc_tokens}
        pieces[r.doc_id] += r.length
    assert pieces == {d: sum(map(len, x)) for d, x in want.items()}
    assert all(place[s] == 2048 for s in range(max(place))) and place[max(place)] <= 2048
