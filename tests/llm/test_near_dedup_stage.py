"""The pipeline's stage links from similarity 0.8 on, op10 from 0.85 on."""

import random

import pytest

import corpus_pipeline
from dayloom.llm import near_dedup as N

from .data import prose
from .test_near_dedup import edited, sets_of


def kept_at(rows, percent):
    """Smallest doc_ids of the components, by brute force."""
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if top(i) == i}


def changed(text, *places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(12):
        # Two edits lose 10 of 90 shingles (80 of 100 are shared) or 10 of 89 (79 of 99).
        for k, words in ((0, 94), (100, 93)):
            text = prose(300 + k + i, words)
            out += [(k + i, text), (1000 + k + i, changed(text, 30, 60))]
    rng = random.Random(31)
    family = prose(500, 100)
    return out + [(2000 + i, edited(family, rng.randrange(0, 6), rng)) for i in range(40)]


def test_stage_equals_brute_force_at_80(spark, rows):
    documents = spark.createDataFrame(
        [(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents, "").collect()}
    assert got == kept_at(rows, 80)
    assert not got & set(range(1000, 1012)) and got >= set(range(1100, 1112))


@pytest.mark.parametrize("block", [N.BLOCK, 7])
@pytest.mark.parametrize("percent", [80, 85, 95])
def test_percent_reaches_both_passes(spark, rows, percent, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    found = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert {r.doc_id for r in found.collect() if r.kept} == kept_at(rows, percent)
