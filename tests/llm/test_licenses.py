"""Licences against a plain version: every window, every template, plain dictionaries."""

import math
import random
import re
from collections import Counter

from odd import prose
from pyspark.sql import functions as F

from rasterloom.llm import licenses as L

SPLIT = re.compile(r"[^a-z0-9]+")


def words(text):
    return [t for t in SPLIT.split(text.lower()) if t and t not in L.FUNCTION_WORDS]


def plain(rows):
    """path -> (weight, licence, cosine), the first two signs turned, by the definition."""
    cue = set(L.WORDS) | {"spdx"}
    hit = lambda line: any(t in cue for t in SPLIT.split(line.lower()))
    lines = [x for _, t in rows for x in re.split(L.LINE_END, t or "") if hit(x)]
    df = Counter(t for x in lines for t in set(words(x)))
    idf = lambda t: math.log((1 + len(lines)) / (1 + df[t])) + 1
    vector = lambda text: {t: n * idf(t) for t, n in Counter(words(text)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(t)) for name, t in L.TEMPLATES]

    def best(text):
        spdx = re.search(L.SPDX, text)
        if spdx:
            return [(-L.NAMED, spdx[1], -1.0)]
        v = vector(text)
        if not v:
            return []
        dots = [(sum(v.get(t, 0) * x for t, x in w.items()) / norm(w), name) for name, w in templates]
        found = [(-round(d / norm(v), 9), name, round(d, 6)) for d, name in dots]
        c, name, weight = min(found)
        return [(-weight, name, c)] if c <= -L.LEAST_COSINE else []

    out = {}
    for path, text in rows:
        all_ = [x.strip(" ") for x in re.split(L.LINE_END, text or "")]
        found = []
        hits = [k for k, x in enumerate(all_) if hit(x)]
        for a in hits:
            end = next((k for k in range(a, len(all_)) if all_[k] == ""), len(all_))
            inside = [b for b in hits if a <= b < end]
            ends = [b for b in inside if b < a + L.WINDOW]
            if a == min(k for k in hits if not any(all_[m] == "" for m in range(k, a))):
                ends += [inside[-1]]  # a whole block
            for b in ends:
                found += best("\n".join(all_[a : b + 1]))
        if re.match(L.FILE_NAME, (path or "").rsplit("/", 1)[-1]) and hits:
            found += best("\n".join(all_))
        out[path] = min(found, default=None)
    return out


def test_against_every_window(spark):
    r = random.Random(3)
    rows = []
    for k in range(60):
        lines = prose(k, r.randrange(0, 40)).replace(",", "\n").split("\n")
        for _ in range(r.randrange(0, 3)):
            piece = words_of(r)
            at = r.randrange(len(lines) + 1)
            lines[at:at] = ["", *piece, ""] if r.random() < 0.5 else piece
        name = ("LICENSE", "x.py", "COPYING.txt")[k % 3]
        rows.append((f"d{k}/{name}", "\n".join(lines)))
    rows += [("e/none.py", None), ("e/empty.py", ""), ("e/spdx.py", "# SPDX-License-Identifier: MIT\nimport os"), ("e/LICENSE", L._MIT + "\n\n" + L._WARRANTY), ("f/LICENSE", L._BSD + "\n" + L._BSD_3 + "\n" + L._BSD_WARRANTY), ("g/LICENSE", L._BSD + "\n" + L._BSD_WARRANTY)]
    got = {x.path: (x.own_license, x.cosine) for x in L.scan(spark, spark.createDataFrame(rows, "path string, text string"), path=F.col("path")).collect()}
    for path, want in plain(rows).items():
        if want is None:
            assert got[path] == (None, None), path
        else:
            assert got[path][0] == want[1] and abs(got[path][1] + want[2]) < 1e-6, path
    assert [got[p][0] for p in ("e/LICENSE", "f/LICENSE", "g/LICENSE")] == ["MIT", "BSD-3-Clause", "BSD-2-Clause"]
    assert sum(x is not None for x, _ in got.values()) > 20


def words_of(r):
    """A template, whole or in part, over several lines."""
    w = r.choice(L.TEMPLATES)[1].split()
    w = w[: r.randrange(1, len(w) + 1)] if r.random() < 0.3 else w
    step = r.choice((4, 9, 30))
    return [" ".join(w[i : i + step]) for i in range(0, len(w), step)]


def test_words_are_found_as_a_whole():
    pattern = re.compile(L.any_of(["a", "ab", "abc", "mit", "x1"]).replace(r"[\p{L}\p{N}]", r"[^\W_]"))
    assert [m[0] for m in pattern.finditer("ab abcd abc. x1 x12 mitt-mit a")] == ["ab", "abc", "x1", "mit", "a"]
