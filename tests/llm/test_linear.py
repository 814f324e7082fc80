"""Scanning of bytes, features, votes and scores against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ROWS, prose

from rasterloom.llm import bytescan, linear, weaklabel
from rasterloom.llm.held import held

TEXTS = [t for _, t, _, _ in ROWS] + ["ÄPFEL Äpfel äpfel!! ÀÉ ñ", "!! ## a. B?", "x" * 300, "word " * 500, "\n\n", "one\ntwo\none\n \none", "日本 日本 ok"]
ALPHABET = st.one_of(st.sampled_from("abAB .,!?#\n\t09ÄäßÉé×日"), st.characters(exclude_categories=("Cs",)))


def folded(b):
    out = bytearray(b.lower())
    for k in range(1, len(b)):
        if b[k - 1] == 0xC3 and 0x80 <= b[k] <= 0x9E and b[k] != 0x97:
            out[k] += 32
    return bytes(out)


def kind(x):
    return "s" if x in b"\t\n\v\f\r " else "d" if 48 <= x < 58 else "l" if x >= 128 or chr(x).isalpha() else "m"


def names(text):
    """The features of a text as readable names."""
    raw, found = (text or "").encode(), set()
    chunks = raw.split()
    for chunk in chunks:
        kinds, low = "".join(map(kind, chunk)), folded(chunk)
        for m in re.finditer("l+", kinds):
            word = low[m.start() : m.end()]
            found.add(("w", word))
            found.update((n, word[:n]) for n in (4, 5) if len(word) > n)
        tail = re.search("m{2,}$", kinds)
        if tail:
            found.add(("t", low[tail.start() : tail.start() + 4]))
        letters = chunk.decode()
        latin = [c for c in letters if c.isascii() or "À" <= c <= "ÿ"]
        if len(chunk) > 2 and any("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" for c in latin) and not any("a" <= c <= "z" or "ß" <= c <= "ÿ" and c != "÷" for c in latin):
            found.add(("u",))
        if len(chunk) <= 2 and set(kinds) == {"m"}:
            found.add(("c", low))
    return found, len(chunks), len({folded(c) for c in chunks})


@pytest.mark.parametrize("most", [bytescan.PIECE, 64])
def test_number_of_features(most, monkeypatch):
    """As many different features as the plain rules give, whatever the pieces; hashes of 20 bits hardly meet in one text."""
    texts = [t for t in TEXTS if most > 64 or t is None or len(t) < 2000]
    monkeypatch.setattr(bytescan.pieces, "__defaults__", (most,))
    row, _ = linear.features(pa.array(texts, pa.string()))
    got = np.bincount(row, minlength=len(texts))
    for k, t in enumerate(texts):
        if most > 64 or len((t or "").encode()) <= most:
            assert got[k] == pytest.approx(len(names(t)[0]) + 2, abs=1 if len(t or "") < 5000 else 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=80)), max_size=6))
def test_features_of_a_batch_are_those_of_its_texts(texts):
    column = pa.array(texts, pa.string())
    row, feature = linear.features(column)
    assert len(set(zip(row.tolist(), feature.tolist(), strict=True))) == len(row)
    for k, t in enumerate(texts):
        _, alone = linear.features(pa.array([t], pa.string()))
        assert feature[row == k].tolist() == alone.tolist()
        assert len(alone) == pytest.approx(len(names(t)[0]) + 2, abs=1)
        assert linear.features(pa.array([folded((t or "").encode()).decode()], pa.string()))[1].tolist() == alone.tolist() or any(c.isupper() for c in t or "")


def plain_votes(text):
    text = text or ""
    raw = text.encode()
    chunks, lines = raw.split(), [x for x in raw.split(b"\n") if x.split()]
    n, low = len(chunks), [folded(c) for c in chunks]
    if not n:
        return [0] * 8 + [2]
    upper = [("u",) in names(c.decode() * 3)[0] for c in chunks]
    odd = sum(c in "#*$%&|<>!0123456789" for c in text) / len(text)
    marks = sum(kind(c[-1]) == "m" and (len(c) == 1 or kind(c[-2]) == "m") for c in chunks)
    stutter = sum(a == b for a, b in zip(low, low[1:], strict=False)) / n
    repeats = len(lines) - len({folded(x) for x in lines})
    stops, capitals = (text.count(".") + text.count("?")) / n, sum(upper) / n
    vote = lambda bad, good=False: 2 if bad else 1 if good else 0
    return [
        vote(sum(c in "#*$%&|<>" for c in text) > 0.3 * n), vote(marks > 0.3 * n), vote(capitals > 0.4), vote(text.count("!") > 0.3 * n), vote(stutter > 0.3), vote(len(lines) >= 4 and repeats > 0.6 * len(lines)),
        vote(odd > 0.3, odd < 0.03), vote(n >= 40 and stutter > 0.15, stutter < 0.08 and len(set(low)) / n**0.9 > 0.4), vote(n < 2, capitals < 0.2 and 0.01 < stops < 0.5 and n >= 5),
    ]


def test_votes():
    assert weaklabel.votes(pa.array(TEXTS, pa.string())).tolist() == [plain_votes(t) for t in TEXTS]
    assert weaklabel.votes(pa.array([], pa.string())).shape == (0, 9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=80), max_size=6))
def test_votes_of_any_text(texts):
    assert weaklabel.votes(pa.array(texts, pa.string())).tolist() == [plain_votes(t) for t in texts]


def test_scores_are_sums_of_weights():
    column = pa.array(TEXTS, pa.string())
    row, feature = linear.features(column)
    r = np.random.default_rng(1)
    weights = {int(f): float(r.normal()) for f in r.choice(np.unique(feature), 60, replace=False)}
    models = [linear.Model(weights, np.zeros(0), 0.5), linear.Model({}, np.zeros(0), -1.0)]
    want = [0.5 + sum(weights.get(int(f), 0.0) for f in feature[row == k]) for k in range(len(TEXTS))]
    got = linear.Scorer(models).logits(column)
    assert got[:, 0] == pytest.approx(want) and (got[:, 1] == -1).all()
    assert models[0].logits([feature[row == k] for k in range(len(TEXTS))]) == pytest.approx(want)


def test_fit_separates_and_needs_two_classes():
    texts = [prose(k, 20) + (" badword" if k % 3 == 0 else "") for k in range(300)]
    row, feature = linear.features(pa.array(texts))
    rows, y = [feature[row == k] for k in range(len(texts))], np.array([float(k % 3 == 0) for k in range(len(texts))])
    assert ((linear.fit(rows, y).logits(rows) > 0) == (y > 0)).all()
    assert linear.fit(rows, np.zeros(len(rows))).weights == {} and linear.fit([], np.zeros(0)).weights == {}


def test_a_very_long_text_without_white_space():
    text = "ab1!" * 1_000_000
    got = linear.Scorer([linear.Model({}, np.zeros(0), 0.25)]).logits(pa.array([text, "short", text]))
    assert got[:, 0].tolist() == [0.25] * 3
    assert weaklabel.votes(pa.array([text])).shape == (1, 9)


def test_a_worker_keeps_one_thing():
    made = []
    first = held("a", 1, lambda: made.append(1) or object())
    assert held("a", 1, lambda: made.append(2) or object()) is first
    held("b", 1, object)
    assert held("a", 1, lambda: made.append(3) or object()) is not first and made == [1, 3]
