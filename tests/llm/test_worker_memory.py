"""What a Python worker holds, and how many of them a running task needs."""

import tracemalloc

import numpy as np
import pytest

from dayloom.llm import near_dedup as N
from dayloom.llm.decontaminate import decontaminate

from .data import prose


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize(("block_bytes", "steps"), [(1 << 20, 1), (200, 1), (50, 1)])
def test_a_decontaminating_task_needs_one_worker(spark, block_bytes, steps):
    items = [(i, prose(50 + i, 12)) for i in range(6)]
    documents = spark.createDataFrame([(i, f"{prose(i, 20)} {items[i % 6][1]}") for i in range(8)], "doc_id long, text string")
    found = decontaminate(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert python_steps(found) == steps
    rows = {r.doc_id: r for r in found.collect()}
    assert all(r["items"] == [str(i % 6)] and r.clean_text.split() == prose(i, 20).split() for i, r in rows.items())


def test_words_leave_nothing_in_a_worker():
    N.shingles("a b c d e f")
    tracemalloc.start()
    try:
        for i in range(20):
            N.shingles(" ".join(f"word{i}x{k}" for k in range(5000)))
        assert tracemalloc.get_traced_memory()[0] < 1 << 20
    finally:
        tracemalloc.stop()


def test_pairs_of_long_texts_take_little_memory():
    rng = np.random.default_rng(3)
    family = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    sets = [np.sort(rng.choice(family, 19_000, replace=False)) for _ in range(40)]
    tracemalloc.start()
    try:
        pairs = N.similar_pairs(sets, percent=99)
        assert tracemalloc.get_traced_memory()[1] < 40 * sum(map(len, sets))
    finally:
        tracemalloc.stop()
    assert not any(N.linked(sets[i], sets[j], 99) for i, j in pairs)


def test_groups_of_long_texts_are_dealt_in_more_blocks(spark, monkeypatch):
    groups = spark.createDataFrame([(h, 10 * h + k, 10 * h + k) for h in (1, 2) for k in range(10)], "hub long, class long, part long")
    texts = spark.createDataFrame([(10 * h + k, 100 if h == 1 else 2000) for h in (1, 2) for k in range(10)], "doc_id long, size long")
    monkeypatch.setattr(N, "BLOCK_BYTES", 4000)
    assert {r.hub: r.blocks for r in N._blocks(groups, texts).collect()} == {1: 1, 2: 5}


def test_long_texts_link_whatever_their_blocks(spark, monkeypatch):
    base = prose(7, 100).split()
    rows = [(i, " ".join([*base[:50], *[f"own{i}"] * (i % 3), *base[50:]])) for i in range(20)]
    want = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(N, "BLOCK_BYTES", 1500)
    got = {(r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
