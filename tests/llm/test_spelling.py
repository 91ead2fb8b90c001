"""Spelling variants against all pairs, word counts against plain loops, and split groups."""

import random
import re
import zlib
from collections import Counter

from dayloom.llm.spelling import near_words, spelling_variants, word_counts
from dayloom.llm.variant_index import VariantIndex
from tests.llm.data import awkward_documents, empty_documents


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(rows, letters=6, times=5):
    total = Counter()
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= letters and n >= times}


def plain_variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_apart(w, v))
        form = near[0] if near and -near[0][0] >= ratio * n else None
        out[w] = (form[1] if form else None, n, len(near), -form[0] if form else None)
    roots = {}
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        roots[w] = r
    return {(w, form, roots[w], n, k, m) for w, (form, n, k, m) in out.items()}


def vocabulary(seed, letters="abcé", number=300):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(number)})


def test_index_finds_all_pairs_once():
    for seed in range(25):
        words = vocabulary(seed, "ab" if seed % 2 else "abc", 5 + 11 * seed)
        queries = words + [w for w in vocabulary(seed + 100, "abz", 40) if w not in words]
        index = VariantIndex(words)
        found = [p for side in (True, False) for p in zip(*(x.tolist() for x in index.near(queries, side)), strict=True)]
        assert len(found) == len(set(found))
        want = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if one_apart(a, b)}
        assert set(found) == want


def test_groups_split_into_blocks_and_joined_ones_agree(spark):
    rng = random.Random(3)
    words = {w: rng.choice([5, 5, 6, 30, 200, 2000]) for w in vocabulary(4, "abc", 600)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {}
    for w in words:
        near = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        want[w] = (len(near), near[0][1] if near else None)
    for block, together in ((16_384, 16_384), (50, 64), (7, 16)):
        rows = near_words(df, block=block, together=together).collect()
        assert {r["word"]: (r["n_near"], r["best"]) for r in rows} == want
        assert len(rows) == len(words)


def documents(seed):
    """Texts over few words with misspellings, so that forms chain and some runs lose a letter."""
    rng = random.Random(seed)
    base = vocabulary(seed, "abcdé", 40)
    weights = [3**k for k in range(8)] * 5
    rows = []
    for i in range(400):
        words = rng.choices(base, weights[: len(base)], k=60)
        for k in rng.sample(range(60), 12):
            w = words[k]
            j = rng.randrange(len(w))
            words[k] = w[:j] + rng.choice(["", "x", w[j] + "a"]) + w[j + 1 :]
        rows.append((None if i % 97 == 0 else i, rng.choice([" ", "-", "1", "\n"]).join(words).title() if i % 3 else " ".join(words)))
    return rows


def test_whole_operator_against_plain_loops(spark):
    rows = documents(8) + [(7, None), (8, ""), (9, "Ā日本 ß"), (10, "ÀÉÎÕÜß×÷ " * 6)]
    rows += [(k, "chainaa " + "chainab " * 8 + "chainbb " * 60) for k in range(500, 508)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts = plain_counts(rows)
    assert {r["word"]: r["n"] for r in word_counts(df).collect()} == counts
    got = [tuple(r) for r in spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants(counts)
    assert set(got) == want and len(got) == len(want)
    assert any(f and f != r for _, f, r, *_ in got)  # a chain of forms


def test_long_runs_awkward_and_empty_tables(spark):
    giant = "a" * 20_000
    df = spark.createDataFrame([(1, " ".join([giant] * 5 + [giant[:-1] + "b"] * 5))], "doc_id long, text string")
    assert sorted((len(r["word"]), r["n_near"]) for r in spelling_variants(df).collect()) == [(20_000, 1)] * 2
    rows = awkward_documents(spark, clash=["word", "n", "Root"])
    counts = plain_counts([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert {r["word"]: r["n"] for r in spelling_variants(rows).collect()} == counts
    assert spelling_variants(empty_documents(spark)).count() == 0
