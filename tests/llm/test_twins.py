"""Feistel numbers digit by digit, severity and feature choice by plain loops, the fit by its likelihood."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from dayloom.llm import pseudonyms, toxicity
from dayloom.llm.rows import read
from tests.conftest import SMALL


def plain_permute(key, value, n, tweak, rounds=10):
    """The network written out: value = left * b + right, sides moved in turn by digests of each other."""
    if n < 2:
        return value
    a = max(2, 2 ** ((n.bit_length() + 1) // 2))
    b = (n + a - 1) // a
    width = (n.bit_length() + 7) // 8

    def digest(r, side, size):
        text = key + b"|" + tweak + b"|" + str(r).encode() + b"|" + str(n).encode() + b"|" + side.to_bytes(width, "big")
        number = 0
        for byte in hashlib.shake_256(text).digest(width + 8):
            number = number * 256 + byte
        return number % size

    while True:
        left, right = value // b, value % b
        for r in range(0, rounds, 2):
            left = (left + digest(r, right, a)) % a
            right = (right + digest(r + 1, left, b)) % b
        value = left * b + right
        if value < n:
            return value


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 10**9, 26**5 * 10**3])
def test_numbers_are_permuted_as_written_out(n):
    network = pseudonyms.Feistel(b"k")
    some = range(n) if n <= 1000 else [0, 1, n // 3, n - 1]
    got = [network.permute(v, n, b"t") for v in some]
    assert got == [plain_permute(b"k", v, n, b"t") for v in some]
    assert [network.restore(v, n, b"t") for v in got] == list(some)
    if n <= 1000:
        assert sorted(got) == list(range(n))


@pytest.mark.parametrize("value", ["12-34", "Ab9.zZ", "---", "0000", "a"])
def test_characters_are_one_number_digit_by_digit(value):
    sets = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    places = [(i, k) for i, c in enumerate(value) for k, s in sets.items() if c in s]
    size, number = 1, 0
    for i, k in places:
        size *= len(sets[k])
        number = number * len(sets[k]) + sets[k].index(value[i])
    number = plain_permute(b"k", number, size, b"x" + "".join(k for _, k in places).encode())
    out = list(value)
    for i, k in reversed(places):
        out[i] = sets[k][number % len(sets[k])]
        number //= len(sets[k])
    assert pseudonyms.characters(value, pseudonyms.Feistel(b"k").permute, b"x") == "".join(out)


def plain_counts(text):
    return Counter(f for w in toxicity.words(text) for f in toxicity.features_of(w))


def test_features_and_severity_by_plain_loops(spark):
    documents = read(spark, SMALL, "documents").select("doc_id", "text")
    labels = read(spark, SMALL, "labels")
    model = toxicity.fit_toxicity(documents, labels)
    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["text"] is not None}
    known = {r["doc_id"]: int(r["toxic"] > 0) for r in labels.collect() if r["toxic"] is not None}
    taught = [(texts[d], t) for d, t in known.items() if d in texts]
    seen = {0: Counter(), 1: Counter()}
    for text, t in taught:
        seen[t].update(set(plain_counts(text)))
    n = Counter(t for _, t in taught)
    scored = []
    for f, k in seen[1].items():
        if k < max(toxicity.LEAST, toxicity.LEAST_SHARE * n[1]):
            continue
        both = (k + seen[0][f]) / (n[0] + n[1])
        z = (k / n[1] - seen[0][f] / n[0]) / (math.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1])) + 1e-9)
        if z >= toxicity.SURE:
            scored.append((-z, f))
    chosen = [f for _, f in sorted(scored)[: toxicity.TOP]]
    assert set(model.features) == set(chosen)
    rows = toxicity.toxicity(documents, model, keep=["doc_id"]).collect()
    assert len(rows) == documents.count()
    for r in rows:
        text = texts.get(r["doc_id"])
        counts = plain_counts(text) if text else Counter()
        score = sum(model.weights[model.features[f]] * math.log1p(c) for f, c in counts.items() if f in model.features)
        above = [1 / (1 + math.exp(min(60, max(-60, c - score)))) if toxicity.words(text) else 0.0 for c in model.cuts]
        assert r["severity"] == pytest.approx(sum(above), abs=1e-9)
        assert r["toxic"] == (r["severity"] >= toxicity.REJECT)


def test_the_fit_is_a_stationary_point_of_the_likelihood():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    noise = rng.logistic(size=600)
    grades = np.digitize(x @ np.array([1.0, -0.5, 0.0, 2.0]) + noise, [-0.5, 1.5])
    weight = rng.uniform(0.5, 2, 600)
    ridge = 1e-3
    w, cuts = toxicity.fit_ordinal(x, grades, weight, ridge=ridge)
    assert (np.diff(cuts) > 0).all()

    def loss(p):
        edges = np.concatenate([[-np.inf], p[4:], [np.inf]])
        score = x.astype(float) @ p[:4]
        chance = lambda e: 1 / (1 + np.exp(-(e - score)))
        p_grade = chance(edges[grades + 1]) - chance(edges[grades])
        return -(weight / weight.sum() * np.log(p_grade)).sum() + ridge / 2 * (p[:4] ** 2).sum()

    at = np.concatenate([w, cuts])
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert abs(loss(at + step) - loss(at - step)) / 2e-5 < 2e-3
