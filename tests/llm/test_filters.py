"""Quality rules, near-duplicates, weak labels, licences, toxicity, and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
from odd import ROWS, labels, no_documents, odd_documents, prose
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import hyperminhash as hm
from rasterloom.llm import licenses, neardup, quality, toxicity, weaklabel
from rasterloom.llm.graph import stars

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tables(name):
    return ds.dataset(f"{SF}/{name}.parquet").to_table().to_pylist()


# Quality rules


def base(text):
    words = WORD.findall(text or "")
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    more = [(20, "a b c d e a b c d e f", "en", "s"), (21, "x " * 40, "en", "s"), (22, "#* $%\n#* $%\n\n &", "en", "s"), (23, "a b c d e f a b c d e f a b c d e", "en", "s")]
    docs = odd_documents(spark).select("doc_id", "text", "lang").unionAll(spark.createDataFrame([(d, t, lang) for d, t, lang, _ in more], "doc_id long, text string, lang string"))
    got = quality.verdicts(spark, docs, labels(spark)).collect()
    want = Counter((d, *base(t)) for d, t, _, _ in [*ROWS, *more])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)  # nothing can be certified on five labels
    assert quality.verdicts(spark, no_documents(spark), labels(spark)).collect() == []
    clashing = odd_documents(spark)
    kept = quality.keep_good(spark, clashing, labels(spark))
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t, _, _ in ROWS if not base(t)[-1])


@pytest.mark.parametrize(("k", "n"), [(0, 1), (0, 500), (3, 500), (7, 900), (40, 2000)])
def test_binomial_tail(spark, k, n):
    p = 0.01
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_certified(spark):
    r = random.Random(4)
    rows = [(i, "en" if i % 4 else None, r.randrange(0, 300), int(r.random() < 0.9)) for i in range(16_000)]
    rows = [(i, s, v + (600 if not q and i % 3 else 0), q) for i, s, v, q in rows]
    zero = {c: F.lit(0) for c in quality.RULES if c != "symbols"}
    measured = spark.createDataFrame([(i, s, v) for i, s, v, _ in rows], "doc_id long, stratum string, symbols int").withColumns(zero | {"base_failed": F.lit(False), "mark": F.col("doc_id")})
    cuts = {c.stratum: c for c in quality.cutoffs(measured, spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")).collect()}
    assert set(cuts) == {"en", None}
    for s, c in cuts.items():
        good = [v for _, t, v, q in rows if t == s and q]
        assert sum(v >= c._q_cut_symbols for v in good) <= quality.ALPHA / len(quality.RULES) * len(good)
        assert 300 <= c._q_cut_symbols <= 700 and c._q_cut_repeats is None


def test_equal_texts_are_one_trial(spark):
    """A cutoff that copies of one text alone would certify is not certified."""
    rows = [(i, i % 2 if i < 8 else 10 + i, 900 if i % 2 == 0 else 0, i % 2) for i in range(20_000)]
    zero = {c: F.lit(0) for c in quality.RULES if c != "symbols"}
    frame = lambda copies: spark.createDataFrame([(i, m % 8 if copies else m, "en", v) for i, m, v, _ in rows], "doc_id long, mark long, stratum string, symbols int").withColumns(zero | {"base_failed": F.lit(False)})
    marks = spark.createDataFrame([(i, q) for i, *_, q in rows], "doc_id long, quality int")
    assert quality.cutoffs(frame(False), marks).count() == 1
    assert quality.cutoffs(frame(True), marks).count() == 0


# Near-duplicates


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset({tuple(w)}) if w else frozenset())


def exact(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows if d is not None}, {d: len(s) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(n=12, copies=12):
    r, rows = random.Random(9), []
    for b in range(n):
        words = prose(b, r.choice((6, 30, 120, 400))).split()
        for _ in range(copies):
            w = list(words)
            for _ in range(r.randrange(0, max(2, len(w) // 40))):
                w[r.randrange(len(w))] = f"new{r.randrange(999)}"
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "block"), [(4, 1024), (5, 4)])
def test_components_are_exact(spark, words, block):
    rows = corpus()
    want, sizes = exact(rows, words)
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=words, block=block).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_documents_near(spark):
    docs = odd_documents(spark)
    got = neardup.near_duplicates(spark, docs, words=4).collect()
    want, _ = exact([(d, t) for d, t, _, _ in ROWS], 4)
    assert len(got) == len(ROWS)
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)
    assert all(r.n_shingles == len(shingle_set(dict((d, t) for d, t, _, _ in ROWS)[r.doc_id], 4)) for r in got if r.doc_id is not None)
    kept = neardup.keep_one(spark, docs, words=4)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, None] + [d for d in {d for d, *_ in ROWS} - {None} if want[d] == d])
    assert neardup.near_duplicates(spark, no_documents(spark)).collect() == []


def test_rows_that_share_an_id(spark):
    """Each row is judged by its own text; one row stays for an id."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "zz"), (7, c, "u"), (7, c, "u"), (None, a, "n"), (9, None, "o"), (9, b, "p")]
    kept = neardup.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string, tag string")).collect()
    got = Counter((r.doc_id, r.text, r.tag) for r in kept)
    assert {k for k in got if k[0] != 9} == {(1, a, "x"), (5, b, "z"), (7, c, "u"), (None, a, "n")} and set(got.values()) == {1}
    assert [k for k in got if k[0] == 9] == [(9, None, "o")]  # the copy of document 5 goes


def test_one_large_group(spark):
    text = prose(1, 60)
    rows = [(i, text if i % 2 else text.replace(text.split()[i % 50], f"w{i % 300}")) for i in range(900)]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=4, block=64).collect()
    want, _ = exact(rows[:200], 4)
    assert sum(r.kept for r in got) <= 3 and set(want.values()) == {0}


def test_spanning_forest():
    r = np.random.default_rng(8)
    for n, m in ((1, 0), (5, 3), (40, 30), (200, 5000)):
        i, j = r.integers(0, n, m), r.integers(0, n, m)
        kept = neardup.spanning(n, i, j, some=64)
        assert (stars(n, i[kept], j[kept]) == stars(n, i, j)).all()
        assert len(kept) == n - len(set(stars(n, i, j).tolist()))  # no edge too many


def test_estimates():
    r = np.random.default_rng(2)
    for n, share in ((12, 0.5), (300, 0.8), (20_000, 0.3)):
        found = []
        for _ in range(40):
            both = r.integers(0, 2**64, int(n * share) or 1, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, n - len(both), dtype=np.uint64)])) for _ in range(2))
            truth = len(both) / (2 * n - len(both))
            equal = (hm.sketch(a) == hm.sketch(b)).sum()
            found.append(hm.corrected(np.array([equal]), np.array([n]), np.array([n]))[0] - truth)
        assert abs(np.mean(found)) < 0.03 and np.std(found) < 0.12


def test_chance_collisions():
    r = np.random.default_rng(3)
    for n, m in ((2000, 2000), (500, 4000)):
        hits = np.mean([(hm.sketch(np.unique(r.integers(0, 2**64, n, dtype=np.uint64))) == hm.sketch(np.unique(r.integers(0, 2**64, m, dtype=np.uint64)))).mean() for _ in range(150)])
        chance = (hm.cell_odds(np.array([n])) * hm.cell_odds(np.array([m]))).sum()
        assert hits == pytest.approx(chance, rel=0.25)


@pytest.mark.parametrize("shared, whole", [(4, 5), (8, 10), (40, 50)])
def test_small_sets_reach_the_exact_check(shared, whole):
    dropped = 0
    for seed in range(1500):
        y = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, whole).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        x = np.sort(np.random.default_rng(-seed % 9973).permutation(y)[:shared])
        columns = {"rep": np.array([0, 1]), "side": np.array([2, 2]), "comp": np.array([0, 1]), "n": np.array([shared, whole]), "registers": np.stack([hm.sketch(x), hm.sketch(y)])}
        dropped += not len(neardup.Group(columns, 80).all_likely(False)[0])
    assert dropped == 0


# Weak labels and toxicity: held-out accuracy


def test_weak_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, scorer = weaklabel.fit(spark, docs)
    got = {r.doc_id: r for r in weaklabel.score(spark, docs, model, scorer).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in tables("labels")}  # never seen in training
    good = [got[d].kept for d, q in truth.items() if q]
    bad = [got[d].kept for d, q in truth.items() if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    assert min(model.accuracies().values()) > 0.5
    odd = weaklabel.score(spark, odd_documents(spark), model, scorer).collect()
    assert Counter(r.doc_id for r in odd) == Counter(d for d, *_ in ROWS)
    assert weaklabel.score(spark, no_documents(spark), *weaklabel.fit(spark, no_documents(spark))).collect() == []


def test_label_model_finds_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20_000) < 0.8
    rates = [(0.6, 0.01), (0.5, 0.02), (0.7, 0.005), (0.4, 0.01), (0.5, 0.01), (0.3, 0.01)]
    found = np.stack([np.where(r.random(len(good)) < np.where(good, g, b), weaklabel.BAD, weaklabel.NONE) for b, g in rates], axis=1)
    judges = np.stack([np.where(r.random(len(good)) < 0.2, weaklabel.NONE, np.where(good ^ (r.random(len(good)) > a), weaklabel.GOOD, weaklabel.BAD)) for a in (0.9, 0.8, 0.85)], axis=1)
    patterns, counts = np.unique(np.hstack([found, judges]), axis=0, return_counts=True)
    model = weaklabel.expectation_maximisation(patterns, counts.astype(float))
    assert model.prior == pytest.approx(0.8, abs=0.03)
    assert list(model.accuracies().values())[6:] == pytest.approx([0.9, 0.8, 0.85], abs=0.03)


def toxic_corpus(n=1500):
    r, rows, marks = random.Random(1), [], []
    for i in range(n):
        words, bad = prose(i, 60).split(), i % 7 == 0
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(("nastyword", "vileterm", "foulname")))
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 5 > 0), int(bad)))
    return rows, marks


def test_toxicity_held_out(spark):
    rows, marks = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(spark, docs, labels(spark, marks[:1000]))
    got = {r.doc_id: r for r in toxicity.score(spark, docs, model).collect()}
    assert [got[d].rejected for d, _, t in marks[1000:]] == [bool(t) for _, _, t in marks[1000:]]
    assert len(model.models[1].dense) == 1  # the later category takes the earlier one's
    kept = toxicity.reject(spark, docs, model)
    assert {r.doc_id for r in kept.collect()} == {d for d in got if not got[d].rejected}
    odd = odd_documents(spark)
    assert toxicity.reject(spark, odd, model).columns == odd.columns
    assert Counter(r.doc_id for r in toxicity.score(spark, odd, model).collect()) == Counter(d for d, *_ in ROWS)
    assert toxicity.reject(spark, no_documents(spark), model).collect() == []


def test_toxicity_without_labels(spark):
    docs = odd_documents(spark)
    for marks in (labels(spark, ()), labels(spark)):
        model = toxicity.train(spark, docs, marks)
        assert not any(r.rejected for r in toxicity.score(spark, docs, model).collect())


# Licences


def test_licences(spark):
    rows = [
        ("repo/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License."),
        ("repo/a.py", "code"), ("repo/sub/b.py", prose(1, 50) + "\nLicensed under the Apache License, Version 2.0."), ("repo/sub/deep/c.py", "code"),
        ("repo/sub/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("repo/sub/deep/er/d.py", None), ("other/e.py", "licence of something else entirely, by nobody"), ("f.py", ""), (None, "code"),
        ("repo/a.py", "code"),
    ]
    df = spark.createDataFrame([(p, t, "x", "x", 1) for p, t in rows], "path string, text string, license string, line string, row int")
    got = sorted(((r.path, r.license, r.license_source, r.inherited_from) for r in licenses.scan(spark, df, path=F.col("path")).collect()), key=str)
    assert got == sorted(
        [("repo/LICENSE", "MIT", "own", None), ("repo/a.py", "MIT", "inherited", "repo"), ("repo/a.py", "MIT", "inherited", "repo"), ("repo/sub/b.py", "Apache-2.0", "own", None), ("repo/sub/deep/c.py", "GPL-3.0", "inherited", "repo/sub/deep"),
         ("repo/sub/deep/COPYING", "GPL-3.0", "own", None), ("repo/sub/deep/er/d.py", "GPL-3.0", "inherited", "repo/sub/deep"), ("other/e.py", None, "none", None), ("f.py", None, "none", None), (None, None, "none", None)], key=str
    )
    assert licenses.scan(spark, df.limit(0), path=F.col("path")).collect() == []


def test_licences_of_documents(spark):
    from rasterloom.llm import queries

    got = {r.doc_id: r.own_license for r in queries.op9_licenses(spark, SF).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for d in tables("documents"):
        reserved = "Proprietary" if "rights reserved" in d["text"] else None
        assert got[d["doc_id"]] == next((v for k, v in lines.items() if k in d["text"].split("\n")), reserved)


def test_licences_without_a_cue_phrase_and_over_lines(spark):
    gpl2 = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n\nimport os"
    want = {
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD-3-Clause",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT", "This program is free software: you can redistribute it and/or modify": "GPL-3.0",
        "Creative Commons Attribution 4.0 International": "CC-BY-4.0", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "/* SPDX-License-Identifier: Apache-2.0 OR MIT */": "Apache-2.0 OR MIT",
        "# Redistribution and use in source\n# and binary forms, with or without\n# modification, are permitted provided\n# that the following conditions are met:": "BSD-3-Clause",
        gpl2: "GPL-2.0", "GNU Affero General Public License version 3": "AGPL-3.0", "a copy of the book": None, "": None,
    }
    rows = [(f"d{k}/x.py", prose(k, 60) + "\n\n" + t) for k, t in enumerate(want)]
    got = {r.path: r.own_license for r in licenses.scan(spark, spark.createDataFrame(rows, "path string, text string"), path=F.col("path")).collect()}
    assert [got[p] for p, _ in rows] == list(want.values())


# Pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out = out.persist()
        seen[name], docs = out.count(), out
    assert 0 < seen["near_duplicates"] < seen["quality"] < seen["toxicity"] < 1000 and seen["packing"] > 0


def test_stages_on_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for make in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, make(spark), str(tmp_path)).count() >= 0
