"""Values beside other words and in less usual spellings."""

import random

import pytest

from dayloom.llm import pseudonyms as P

NETWORK = P.Feistel(b"key")


def with_check(body):
    return body + str(P.luhn(body))


def grouped(card):
    return " ".join(card[i : i + 4] for i in range(0, len(card), 4))


@pytest.mark.parametrize(
    ("text", "kinds", "clear"),
    [
        ("pay BE68 5390 0754 7034 THE sum", {"iban": 1}, " THE sum"),
        ("pay BE68 5390 0754 7034 2024", {"iban": 1}, " 2024"),
        ("BE68 5390 0754 7034 GB82 WEST 1234 5698 7654 32 NOW", {"iban": 2}, " NOW"),
        ("ID12 BE68 5390 0754 7034", {"iban": 1}, "ID12 "),
        ("call 555 123 4567 now", {"phone": 1}, " now"),
        ("call (555) 123 4567 now", {"phone": 1}, " now"),
        ("call 1-800-555-1234 now", {"phone": 1}, "call 1-"),
        ("call 1 (800) 555-1234 now", {"phone": 1}, "call 1 ("),
        (f"card {grouped(with_check('621234567890123456'))} end", {"card": 1}, " end"),
        (f"card {grouped(with_check('621234567890123456')).replace(' ', '-')} end", {"card": 1}, " end"),
        ("card 4111 1111 1111 1111 123 end", {"card": 1}, " 123 end"),
        ("not 4111 1111 1111 1112 123", {}, "1112 123"),
    ],
)
def test_value_is_replaced_and_restored(text, kinds, clear):
    out, counts = P.pseudonymise(text, NETWORK.permute)
    assert counts == kinds and len(out) == len(text) and clear in out
    for value in ("5390", "7034", "WEST", "123 4567", "555-1234", "6212", "3456 7890", "4111"):
        assert not kinds or value not in out
    assert P.pseudonymise(out, NETWORK.restore)[0] == text


def test_same_number_under_plus_one_stays_linked():
    out = [P.pseudonymise(t, NETWORK.permute)[0] for t in ("+1-800-555-1234", "1-800-555-1234", "1 800 555 1234")]
    assert len({"".join(c for c in x if c.isdigit()) for x in out}) == 1


def test_cards_before_three_digits_are_restored():
    rng = random.Random(3)
    for _ in range(200):
        card = with_check("".join(rng.choice("123456789") for _ in range(rng.choice([15, 18]))))
        text = f"{grouped(card)} {rng.randrange(100, 1000)}"
        out, counts = P.pseudonymise(text, NETWORK.permute)
        assert counts == {"card": 1}
        assert P.pseudonymise(out, NETWORK.restore)[0] == text
