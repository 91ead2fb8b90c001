"""Runs against every period of every stretch, digests against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np

from dayloom.llm import periodic_runs as module
from dayloom.llm.periodic_runs import periodic_runs, runs_of, runs_report
from dayloom.llm.recompression import Grammar
from tests.llm.data import awkward_documents, empty_documents


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    letters, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 400])
    w = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a = rng.randrange(n)
        p, m = 1 + rng.randrange(max(1, (n - a) // 3 + 1)), rng.randrange(n - a + 1)
        for i in range(a, a + m):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(2)
    for turn in range(120):
        monkeypatch.setattr(module, "CANDIDATES", 3 if turn % 2 else 1 << 20)
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 7))]
        assert runs_of(texts) == [plain_runs(w) for w in texts]


def test_extensions_on_the_grammar():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 4, 50):
        texts = [rng.integers(0, letters, rng.integers(1, 300)) + 10 for _ in range(6)]
        ids = np.concatenate([[0]] + [np.append(t, k + 1) for k, t in enumerate(texts)])
        x, y = rng.integers(0, len(ids), (2, 500))
        x, y = x[x != y], y[x != y]
        for a, b, length in zip(x, y, Grammar(ids, 10).common(x, y), strict=True):
            k = 0
            while max(a, b) + k < len(ids) and ids[a + k] == ids[b + k]:
                k += 1
            assert length == k


def test_report_against_plain_loops(spark):
    rng = random.Random(9)
    rows = [(i if i % 50 else None, "\x0b ".join(w.decode() for w in repetitive(rng)) + rng.choice(["", " \n", "\xa0"])) for i in range(300)]
    rows += [(1, None), (2, ""), (3, " \t\r\n"), (10, "a " * 5), (10, "a " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(w)
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((
            doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        ))
    assert sorted(map(repr, (tuple(r) for r in runs_report(df).collect()))) == sorted(map(repr, want))


def test_awkward_long_and_empty_tables(spark):
    rows = awkward_documents(spark, clash=["n_runs", "Start", "runs"])
    assert runs_report(rows).count() == periodic_runs(rows).count() == rows.count()
    assert {r["collapsed_text"] is None for r in periodic_runs(rows).filter("text IS NULL").collect()} == {True}
    assert runs_report(empty_documents(spark)).count() == 0
    long = spark.createDataFrame([(1, "x y z " * 300_000)], "doc_id long, text string")
    found = periodic_runs(long).first()
    assert [tuple(r) for r in found["runs"]] == [(0, 900_000, 3)] and found["collapsed_text"] == "x y z"
