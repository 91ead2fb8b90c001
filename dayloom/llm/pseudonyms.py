"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel permutation.

Found and, where the kind has a rule, validated: e-mail addresses, IPv4 addresses (octets), card
numbers (Luhn), IBANs (mod 97), US social security numbers, international and
North American phone numbers, calendar
dates (ISO, day.month.year, month/day/year or day/month/year where only that is a date), access keys
and the values of password, token, secret and key assignments. Each value is permuted within its
format: letters stay letters of their case, digits stay digits, punctuation stays; cards stay Luhn
valid, IBANs keep their country and valid check digits, dates stay dates of 1900 to 2099.

The permutation depends on the key and the kind only, so equal values stay linked across documents;
whoever holds the key can undo it (``restore``). Spellings that differ in punctuation alone stay
linked too, since only letters and digits enter the permutation.

A card or IBAN may be followed by other digits or words; North American numbers may have spaces and a
leading 1, which stays. Of a card in groups 4-4-4-4 before three more digits the pseudonym is permuted
again where all 19 digits would be a card, so that it can be undone.

Defined results: a null text stays null, texts without such values stay as they are, whole texts of
any length are searched, and a value that two kinds match belongs to the first in the list above.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from dayloom.llm.rows import with_arrow_columns

KEY = b"replace this key in production"
ROUNDS = 10
_DAYS = (dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() + 1)


class Feistel:
    """A keyed permutation of range(n) for any n, one per tweak: an unbalanced Feistel network over
    a * b >= n whose results beyond n are permuted again until they fall below."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: bytes, number: int, n: int, value: int, size: int) -> int:
        width = (n.bit_length() + 7) // 8
        text = b"|".join([self.key, tweak, b"%d" % number, b"%d" % n, value.to_bytes(width, "big")])
        return int.from_bytes(hashlib.shake_256(text).digest(width + 8), "big") % size

    def _sides(self, n: int) -> tuple[int, int]:
        a = max(2, 1 << ((n.bit_length() + 1) // 2))
        return a, -(-n // a)

    def permute(self, value: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return value
        a, b = self._sides(n)
        while True:
            left, right = divmod(value, b)  # left below a, right below b
            for r in range(self.rounds):
                if r % 2:
                    right = (right + self._round(tweak, r, n, left, b)) % b
                else:
                    left = (left + self._round(tweak, r, n, right, a)) % a
            value = left * b + right
            if value < n:
                return value

    def restore(self, value: int, n: int, tweak: bytes) -> int:
        if n < 2:
            return value
        a, b = self._sides(n)
        while True:
            left, right = divmod(value, b)
            for r in reversed(range(self.rounds)):
                if r % 2:
                    right = (right - self._round(tweak, r, n, left, b)) % b
                else:
                    left = (left - self._round(tweak, r, n, right, a)) % a
            value = left * b + right
            if value < n:
                return value


Permutation = Callable[[int, int, bytes], int]

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def characters(value: str, permute: Permutation, tweak: bytes, alphabets=_ALPHABETS) -> str:
    """The letters and digits of ``value`` permuted together as one mixed-radix number."""
    places = [(i, a, a.index(c)) for i, c in enumerate(value) for a in alphabets if c in a]
    number, size = 0, 1
    for _, alphabet, digit in places:
        number, size = number * len(alphabet) + digit, size * len(alphabet)
    shape = "".join("0aA"[_ALPHABETS.index(a)] if a in _ALPHABETS else "h" for _, a, _ in places)
    number = permute(number, size, tweak + shape.encode())
    out = list(value)
    for i, alphabet, _ in reversed(places):
        number, digit = divmod(number, len(alphabet))
        out[i] = alphabet[digit]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1]) and bool(digits.strip("0"))


def _card(found: re.Match, permute: Permutation) -> str | None:
    """The card, of groups 4-4-4-4-3 the first four where the fifth makes it invalid."""
    value, after = found[0], ""
    digits = re.sub(r"\D", "", value)
    if not _is_card(digits):
        if not re.fullmatch(r"(?:\d{4} ){4}\d{3}", value) or not _is_card(digits[:16]):
            return None
        value, digits, after = value[:19], digits[:16], digits[16:]
    while True:
        body = characters(digits[:-1], permute, b"card")
        digits = body + str(luhn(body))
        # Permuted again where it would be read together with the digits after it.
        if not after or not _is_card(digits + after):
            break
    fresh = iter(digits)
    return re.sub(r"\d", lambda _: next(fresh), value)


_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        x.split(":")
        for x in (
            "15:NO;16:BE;18:DK,FI,FO,GL,NL,SD;19:MK,SI;20:AT,BA,EE,KZ,LT,LU,XK;21:CH,HR,LI,LV;"
            "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA;23:AE,GI,IL,IQ,OM,TL;24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG;"
            "25:LY,PT,ST;26:IS,TR;27:FR,GR,IT,MC,MR,SM;28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV;29:BR,EG,PS,QA,UA;"
            "30:JO,KW,MU;31:MT,SC;32:LC"
        ).split(";")
    )
    for country in countries.split(",")
}


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _iban(found: re.Match, permute: Permutation) -> str | None:
    """The IBAN of its country's length, else the whole match, else, of other countries, fewer groups."""
    words = found[0].split(" ")
    values = [" ".join(words[:n]) for n in range(len(words), 0, -1)]
    length = _IBAN_LENGTHS.get(found[0][:2])
    if length:
        values = [v for v in values if len(v.replace(" ", "")) == length] + values[:1]
    for value in values:
        plain = value.replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_number(plain[4:] + plain[:4]) % 97 == 1:
            break
    else:
        return None
    body = characters(plain[4:], permute, b"iban" + plain[:2].encode())
    check = 98 - _iban_number(f"{body}{plain[:2]}00") % 97
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return re.sub(r"\S", lambda _: next(fresh), value)


def _ipv4(found: re.Match, permute: Permutation) -> str | None:
    octets = [int(x) for x in found[0].split(".")]
    if max(octets) > 255:
        return None
    number = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ipv4")
    return ".".join(map(str, number.to_bytes(4, "big")))


def _email(found: re.Match, permute: Permutation) -> str:
    name, _, host = found[0].rpartition("@")
    labels, dot, top = host.rpartition(".")
    return f"{characters(name, permute, b'mailbox')}@{characters(labels, permute, b'host')}{dot}{top}"


def _phone(found: re.Match, permute: Permutation) -> str | None:
    country, rest = found[1] or "", found[2]
    if not 7 <= len(re.sub(r"\D", "", rest)) <= 14:
        return None
    code = "+1" if country[:1] == "1" else country
    return country + characters(rest, permute, b"phone" + code.encode())


def _ssn(found: re.Match, permute: Permutation) -> str | None:
    area, group, serial = found[0].split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    # Areas 001-899 without 666, groups 01-99, serials 0001-9999 as one number.
    place = int(area) - 1 - (int(area) > 666)
    number = (place * 99 + int(group) - 1) * 9999 + int(serial) - 1
    number = permute(number, 898 * 99 * 9999, b"ssn")
    number, serial = divmod(number, 9999)
    place, group = divmod(number, 99)
    place += 1 + (place >= 665)
    return f"{place:03d}-{group + 1:02d}-{serial + 1:04d}"


def _day(year: str, month: str, day: str) -> int | None:
    try:
        at = dt.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    return at if _DAYS[0] <= at < _DAYS[1] else None


def _date(found: re.Match, permute: Permutation) -> str | None:
    a, mark, b, c = found["a"], found["mark"], found["b"], found["c"]
    orders = {"-": ["ymd"], ".": ["dmy"], "/": ["mdy", "dmy"]}[mark] if len(a) < 3 else ["ymd"]
    if (mark == "-") != (len(a) == 4) and mark != "/" or (len(a) == 4) == (len(c) == 4):
        return None
    for order in orders:
        parts = dict(zip(order, (a, b, c), strict=True))
        at = _day(parts["y"], parts["m"], parts["d"])
        if at is not None:
            fresh = dt.date.fromordinal(_DAYS[0] + permute(at - _DAYS[0], _DAYS[1] - _DAYS[0], b"date"))
            # Padded unless the found one was plainly not, so that the new date reads the same way.
            pad = any(len(parts[k]) == 2 and parts[k][0] == "0" for k in "md") or all(
                len(parts[k]) == 2 for k in "md"
            )
            out = {"y": f"{fresh.year:04d}"}
            out |= {k: f"{v:02d}" if pad else str(v) for k, v in (("m", fresh.month), ("d", fresh.day))}
            return mark.join(out[k] for k in order)
    return None


def _secret(found: re.Match, permute: Permutation) -> str:
    value = found["value"]
    if re.fullmatch(r"[0-9a-f]+", value):
        return found["name"] + characters(value, permute, b"hex", ("0123456789abcdef",))
    return found["name"] + characters(value, permute, b"secret")


def _access_key(found: re.Match, permute: Permutation) -> str:
    return found[1] + characters(found[2], permute, b"access", ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",))


# Kinds in the order in which they are searched; what one has replaced the next ones leave alone.
KINDS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    (
        "secret",
        re.compile(
            r"(?P<name>(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,4}[:=]\s{0,4}[\"']?)"
            r"(?P<value>[A-Za-z0-9+/_\-.=]{6,})"
        ),
        _secret,
    ),
    ("access_key", re.compile(r"\b(AKIA|ASIA)([0-9A-Z]{16})\b"), _access_key),
    ("email", re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}\b"), _email),
    ("ipv4", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"), _ipv4),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"), _iban),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3})([ .\-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .\-]?\d{2,5}){1,5})(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+\-.])(1[-. ])?(\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}([-. ])\d{3}\3\d{4})(?![\w\-])"), _phone),
    ("ssn", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"), _ssn),
    (
        "card",
        re.compile(
            r"(?<!\d)(?<!\d[.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1(?:\d{4}\1\d{3}|\d{1,7})|\d{4}([ \-])\d{6}\2\d{5})(?!\d)(?!-\d)"
        ),
        _card,
    ),
    ("date", re.compile(r"(?<![\d./\-])(?P<a>\d{1,4})(?P<mark>[-./])(?P<b>\d{1,2})(?P=mark)(?P<c>\d{1,4})(?![\d/\-]|\.\d)"), _date),
)
_SHORTER = ("iban", "card")  # kinds whose value may be the beginning of the match, and keeps its length
_ANY = re.compile(r"[0-9@=:]")


def pseudonymise(text: str | None, permute: Permutation) -> tuple[str | None, dict[str, int]]:
    """The text with every value replaced, and the number of values by kind."""
    counts: dict[str, int] = {}
    if not text or not _ANY.search(text):
        return text, counts
    spans: list[tuple[int, int, str]] = []  # sorted, apart from each other
    for kind, pattern, replace in KINDS:
        at = 0
        while found := pattern.search(text, at):
            at = found.end()
            place = bisect(spans, (found.start(), found.end(), ""))
            if place and spans[place - 1][1] > found.start():
                continue
            if place < len(spans) and spans[place][0] < found.end():
                continue
            fresh = replace(found, permute)
            if fresh is not None:
                if kind in _SHORTER:
                    at = found.start() + len(fresh)
                spans.insert(place, (found.start(), at, fresh))
                counts[kind] = counts.get(kind, 0) + 1
            elif kind == "iban":
                at = found.start() + 1  # another one may begin inside
    out, at = [], 0
    for start, end, fresh in spans:
        out += [text[at:start], fresh]
        at = end
    return "".join([*out, text[at:]]), counts


def pseudonyms(
    documents: DataFrame, key: bytes = KEY, *, undo: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """``documents`` (columns ``keep``) with clean_text, n_values and kinds (values by kind)."""

    def replace(table: pa.Table):
        network = Feistel(key)
        permute = network.restore if undo else network.permute
        found = [pseudonymise(t, permute) for t in table.column("text").to_pylist()]
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([sum(f[1].values()) for f in found], pa.int64()),
            pa.array([sorted(f[1].items()) for f in found], pa.map_(pa.string(), pa.int64())),
        ]

    return with_arrow_columns(
        documents, replace, "clean_text string, n_values long, kinds map<string, long>", size_of="text", keep=keep
    )
