"""Windows of long, sparse, repeated and unnumbered turns against plain loops over whole conversations."""

import random
import re

import pytest

from dayloom.llm import chat


def size(text):
    return len(re.findall(r"[^\W_]+|[^\s\w]|_", text)) + chat.OVERHEAD


def plain_windows(turns, budget, history, stretch=1 << 60):
    """(context, new) of every window, from the prefix sums of the whole conversation."""
    before = [0]
    for _, text in turns:
        before.append(before[-1] + size(text))
    system = next((i for i, (role, _) in enumerate(turns) if role == "system"), None)
    room = max(1, budget - history - (size(turns[system][1]) if system is not None else 0))
    out, first = [], 0
    while first < len(turns):
        last = first
        while last + 1 < len(turns) and before[last + 2] - before[first] <= room and before[last + 1] // stretch == before[first] // stretch:
            last += 1
        begin = next(h for h in range(first + 1) if before[first] - before[h] <= history)
        led = [turns[system]] if system is not None and system < begin else []
        out.append((led + turns[begin:first], turns[first : last + 1]))
        first = last + 1
    return out


def built(frame, conv, **options):
    windows = chat.chat_windows(frame, **options).filter(f"conv_id = {conv}").orderBy("stretch", "window").collect()
    out = []
    for w in windows:
        turns = [(r, t) for r, t in re.findall(r'<turn role="([^"]*)">([^<]*)</turn>', w["formatted"])]
        out.append((turns[: w["n_context"]], turns[w["n_context"] :]))
    return out


def conversation(seed, n):
    rng = random.Random(seed)
    roles = ["system", *(["user", "assistant"] * n)]
    return [(roles[i], f"t{i:05d} " + "word " * rng.randrange(1, 14)) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    long, sparse, same = conversation(1, 5000), conversation(2, 60), conversation(3, 40)
    rows = [(1, i, r, t) for i, (r, t) in enumerate(long)]
    rows += [(2, 1000 * i, r, t) for i, (r, t) in enumerate(sparse)]
    rows += [(3, None, r, t) for r, t in same] + [(4, 7, r, t) for r, t in same]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), long, sparse, same


def test_five_thousand_turns_have_no_borders(frame):
    df, long, sparse, _ = frame
    options = {"budget": 300, "history": 60}
    assert built(df, 1, **options) == plain_windows(long, **options)
    assert built(df, 2, **options) == plain_windows(sparse, **options)


def test_unnumbered_and_repeated_turns_are_ordered_by_role_and_text(frame):
    df, _, _, same = frame
    options = {"budget": 200, "history": 40}
    for conv in (3, 4):
        assert built(df, conv, **options) == plain_windows(sorted(same), **options)


@pytest.mark.parametrize("stretch", [100, 1000])
def test_history_crosses_the_start_of_a_stretch(frame, stretch):
    df, long, _, _ = frame
    options = {"budget": 300, "history": 60, "stretch": stretch}
    found = built(df, 1, **options)
    assert found == plain_windows(long, **options)
    assert all(context for context, _ in found[1:])


def test_rows_repeated_whole_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "again")] * 500 + [(1, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    want = plain_windows([("user", "again")] * 500 + [("assistant", "yes")], 50, 10)
    assert built(df, 1, budget=50, history=10) == want
    assert chat.chat_windows(df.limit(0)).count() == 0
