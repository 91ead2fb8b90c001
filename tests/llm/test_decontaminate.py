import hashlib
import random
import re

import numpy as np
import pytest

from dayloom.llm import decontaminate as D
from dayloom.llm.fm_index import FMIndex, suffix_array

from .data import awkward_documents, empty_documents, prose


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(documents, items, size=10):
    """Per row: words, hit words and sorted items, by trying every window at every place."""
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)]
    out = []
    for doc, text in documents:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} if item is not None else set()
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        top = int(rng.integers(1, 4))
        text = rng.integers(0, top + 1, rng.integers(1, 60)).astype(np.int32)
        index = FMIndex(text, top)
        order = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert list(suffix_array(text.astype(np.int64), index.bits)) == order
        patterns = np.full((6, 5), -1)
        for row in patterns:
            n = rng.integers(1, 6)
            row[5 - n :] = rng.integers(0, top + 1, n)
        for row, low, high in zip(patterns, *index.search(patterns), strict=True):
            plain = [int(c) for c in row if c >= 0]
            want = [i for i in range(len(text)) if list(text[i : i + len(plain)]) == plain]
            assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == want


@pytest.fixture(scope="module")
def items():
    base = prose(100, 25).split()
    return [
        (1, " ".join(base)),
        (10, " ".join(base)),  # the same passage under another id
        (2, "one two"),  # shorter than a window
        (3, ""),
        (4, None),
        (None, prose(101, 12)),
        (5, "ÀÉ ß 中文"),
        (6, "..."),
    ]


def dirty(spark, items):
    passage, other = items[0][1], items[5][1]
    rows = [
        (100, f"{prose(5)} {passage.upper()}! {prose(6)}"),
        (101, f"{prose(5)} {' '.join(passage.split()[3:16])} {prose(6)} {other}"),
        (102, passage),
        (103, " ".join(passage.split()[:9])),  # nine words are no window
        (104, f"{passage} {passage}"),
        (104, f"{passage} {passage}"),
    ]
    return awkward_documents(spark, ["N_WORDS", "items"]).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True
    )


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits_equal_brute_force(spark, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    documents = dirty(spark, items)
    got = D.decontaminate(documents, benchmark, block_bytes=block_bytes, shard_bytes=3000)
    rows = got.collect()
    assert got.columns.count("n_words") == 1 and "N_WORDS" not in got.columns
    want = brute([(r.doc_id, r.text) for r in documents.collect()], items)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, r.n_words, r.hit_words, r["items"]) for r in rows], key=key) == sorted(want, key=key)
    for r in rows:
        if r.hit_words:
            left = [w for i, w in enumerate(words(r.text)) if i not in set(r.hit_words)]
            assert words(r.clean_text) == left
        else:
            assert r.clean_text == r.text


def test_report_and_empty_tables(spark, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in D.decontamination_report(dirty(spark, items), benchmark).collect()}
    assert rows[102].contaminated and rows[102].n_items == 2
    assert rows[102].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert not rows[103].contaminated and rows[103].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (rows[3].n_words, rows[3].n_hit) == (0, 0)
    assert D.decontamination_report(empty_documents(spark), benchmark).count() == 0
    none = D.decontamination_report(dirty(spark, items), benchmark.limit(0)).collect()
    assert len(none) == 23 and not any(r.contaminated for r in none)


def test_windows_in_random_texts():
    rng = random.Random(3)
    letters = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    for _ in range(50):
        items = [(i, letters(rng.randrange(0, 7))) for i in range(3)]
        docs = [(i, letters(rng.randrange(0, 25))) for i in range(4)]
        found = D.Windows([(i, t.encode()) for i, t in items], 4).hits([t.encode() for _, t in docs])
        want = brute(docs, items, 4)
        assert [(n, list(h), sorted(s)) for n, h, s in found] == [w[1:] for w in want]
