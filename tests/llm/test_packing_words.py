"""Words of a text share one memo entry whatever their capitals and closing marks; ids stay the tokenizer's."""

import random

import numpy as np
import public_tokenizers

from dayloom.llm import packing

SIGNS = [*"abXYZ019 \t\n.,;:!?'\"$%&*#()-_`~^{}[]|\\/@<>=+", *"éÉàßíÿŸİſΣς÷×…“中́ \u0085ﬁ", "'s", "'ll", " A", "a.", "é.", "X$$$", "<|endoftext|>", "<|Endoftext|>."]


def test_one_entry_for_all_forms_of_a_word():
    tokens = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    packing.tokens_and_cuts("Stone stone, STONE. stone%%% Stone!? stone.*** garçon, garçon###", tokens)
    assert set(tokens) == {b"stone", "garçon".encode(), b",", b".", b"%%%", b"!?", b".***", b"###"}


def test_ids_are_those_of_the_whole_text():
    tokens = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(60)))
        ids, ends, _ = packing.tokens_and_cuts(text, tokens)
        want = [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, packing.END]
        assert np.frombuffer(ids, "<u4").tolist() == want and ends[-1] == len(want), repr(text)


def test_cuts_are_cheapest():
    rng = random.Random(6)
    for _ in range(200):
        ends = np.cumsum([rng.randrange(1, 9) for _ in range(rng.randrange(1, 14))]).tolist()
        costs = [rng.choice([0, 2, 5]) for _ in ends]
        best = {0: 0}
        for end, cost in zip(ends, costs, strict=True):
            best[end] = min(best[a] + 10 - (end - a) + cost for a in best if end - a <= 10)
        cuts = packing.best_cuts(ends, costs, 10)
        spent, at = 0, 0
        for i in cuts:
            assert ends[i] - at <= 10
            spent, at = spent + 10 - (ends[i] - at) + costs[i], ends[i]
        assert at == ends[-1] and spent == best[ends[-1]]
