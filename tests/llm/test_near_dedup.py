import random

import numpy as np
import pytest

from dayloom.llm import near_dedup as N
from dayloom.llm.components import components

from .data import awkward_documents, empty_documents, prose


def sets_of(rows):
    out = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        out[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    path = [(i, i + 1) for i in range(40)]  # a long path, a star, repeats, loops and random links
    star = [(100, 100 + i) for i in range(1, 30)]
    links = path + star + star + [(7, 7)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_pairs_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.integers(0, 10**9, 40)
        sets = []
        for _ in range(12):
            x = base[: rng.integers(1, 41)].copy()
            x[rng.random(len(x)) < rng.random() * 0.2] += rng.integers(1, 10**6)
            sets.append(np.unique(x).astype(np.uint64))
        found = {tuple(p) for p in N.similar_pairs(sets).tolist()}
        want = {(i, j) for j in range(12) for i in range(j) if N.linked(sets[i], sets[j])}
        assert want <= found


def test_families_equal_brute_force(spark):
    rng = random.Random(11)
    base, other = prose(50, 120), prose(51, 90)
    rows = [(1000 - i, edited(base, rng.randrange(0, 12), rng)) for i in range(60)]
    rows += [(2000 + i, edited(other, rng.randrange(0, 8), rng)) for i in range(40)]
    rows += [(3000 + i, base) for i in range(30)]  # exact copies
    rows += [(4000 + i, prose(60 + i, 70) + " " + " ".join(base.split()[:60])) for i in range(30)]  # a shared passage
    rows += [(5000, "a b c"), (5001, "A  b\nc"), (5002, "a b"), (5003, ""), (5004, None), (5005, " ")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(70, 60)
    rows = [(i, edited(base, rng.randrange(0, 7), rng)) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(N, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    documents = awkward_documents(spark, ["class", "low", "n_shingles", "component_id"])
    rows = N.near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.component_id, r.kept))
    assert by_id[0] == {(0, True)} and by_id[1] == {(0, False)}
    assert by_id[2] == {(2, True)} and by_id[3] == {(3, True)}  # without words: linked with nothing
    assert by_id[None] == {(None, True)}
    assert by_id[9] == {(8, False)}  # one more word at the end
    kept = N.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(0) == 1 and 1 not in ids and ids.count(None) == 2


@pytest.mark.parametrize("call", [N.near_duplicates, N.one_of_each])
def test_empty_table(spark, call):
    assert call(empty_documents(spark)).count() == 0
