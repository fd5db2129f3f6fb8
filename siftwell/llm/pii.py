"""Format-preserving pseudonyms: a keyed Feistel permutation inside each value's own format.

Validated values only: payment card numbers (issuer digit and Luhn), US social security numbers, US telephone
numbers, IPv4 addresses, dates, e-mail addresses and access key ids. A value is read as a number below the
size of its format, permuted by a Feistel network, and permuted again until the result is valid too; so
every value has a pseudonym of its own format, equal values have equal ones in every document, and who has the key
can turn them back. Card numbers next to other digits are the one exception to equality: where their pseudonyms could
be read as numbers cut elsewhere, they are permuted again. Separators, domains of e-mail addresses and text around values stay.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates of these years stay among themselves; so do all others.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DAYS = datetime.date.max.toordinal()
KINDS = ("email", "card", "ssn", "phone", "ipv4", "date", "key")

_EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", re.ASCII)
_FORMS = (
    r"(?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\.?\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/.-]?\d)"
)
#: Digits that may hold card numbers, one after the other; forms that go before them.
_RUN = re.compile(rf"(?<![\w.-])(?:{_FORMS}|(?P<run>\d(?:[ -]?\d){{12,}}))", re.ASCII)
_NUMBER = re.compile(
    rf"(?<![\w.-])(?:{_FORMS}"
    r"|(?P<key>AKIA[A-Z0-9]{16})(?![A-Za-z0-9])"
    r")|(?<![\w.-])(?P<phone>(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-])",
    re.ASCII,
)
CARD_LENGTHS = (19, 16, 15, 14, 13)


def permute(key: bytes, tweak: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on just enough bits, walked until it is inside."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    n = -(-half // 8)

    def f(i: int, v: int) -> int:
        data = f"{tweak}/{size}/{i}/{v}".encode()
        return int.from_bytes(b"".join(hashlib.blake2b(data, key=key, digest_size=min(64, n - a), salt=a.to_bytes(4, "big")).digest() for a in range(0, n, 64)), "big") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for i in reversed(range(ROUNDS)):
                a, b = b ^ f(i, a), a
        else:
            for i in range(ROUNDS):
                a, b = b, a ^ f(i, b)
        x = a << half | b
        if x < size:
            return x


def walk(key: bytes, tweak: str, x: int, size: int, valid: Callable[[int], bool], back: bool) -> int:
    """permute() until valid; from a valid x this ends, and it is a permutation of the valid numbers."""
    while True:
        x = permute(key, tweak, x, size, back)
        if valid(x):
            return x


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * (1 + (i % 2 == 0)), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _fill(value: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def _card_ok(d: str) -> bool:
    return len(d) in CARD_LENGTHS and d[0] in "23456" and luhn_digit(d[:-1]) == d[-1]


def card_spans(run: str) -> list[tuple[int, int]]:
    """Card numbers in digits with single separators: all of it, or else what begins and ends at separators, the longest first."""
    at = [i for i, c in enumerate(run) if c in _TEN]
    d = "".join(run[i] for i in at)
    if _card_ok(d):
        return [(0, len(run))]
    out, i = [], 0
    while i <= len(d) - CARD_LENGTHS[-1]:
        n = 0
        if d[i] in "23456" and (i == 0 or at[i] - at[i - 1] > 1):
            n = next((n for n in CARD_LENGTHS if i + n <= len(d) and (i + n == len(d) or at[i + n] - at[i + n - 1] > 1) and _card_ok(d[i : i + n])), 0)
        if n:
            out.append((at[i], at[i + n - 1] + 1))
        i += n or 1
    return out


def cards(key: bytes, run: str, spans: list[tuple[int, int]], back: bool) -> str:
    """run with the card numbers at spans replaced, again until the same spans are found in it: so that it can be turned back."""
    while True:
        out, last = [], 0
        for a, b in spans:
            out += [run[last:a], pseudonym(key, "card", run[a:b], back)]
            last = b
        run = "".join([*out, run[last:]])
        if card_spans(run) == spans:
            return run


def card(key: bytes, value: str, back: bool) -> str | None:
    d = _digits(value)
    if not _card_ok(d):
        return None
    n = len(d) - 1
    body = f"{walk(key, 'card', int(d[:-1]), 10**n, lambda x: f'{x:0{n}d}'[0] in '23456', back):0{n}d}"
    return _fill(value, body + luhn_digit(body))


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(key: bytes, value: str, back: bool) -> str | None:
    x = int(_digits(value))
    return _fill(value, f"{walk(key, 'ssn', x, 10**9, _ssn_ok, back):09d}") if _ssn_ok(x) else None


def _phone_ok(x: int) -> bool:
    return x // 10**9 >= 2 and x // 10**4 % 1000 >= 200


def phone(key: bytes, value: str, back: bool) -> str | None:
    d = _digits(value)
    x, lead = int(d[-10:]), d[:-10]
    return _fill(value, lead + f"{walk(key, 'phone', x, 10**10, _phone_ok, back):010d}") if _phone_ok(x) else None


def _ip_ok(x: int) -> bool:
    return 0 < x >> 24 < 224 and x >> 24 != 127


def ipv4(key: bytes, value: str, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    # addresses of hosts stay addresses of hosts; this network's, loopback, multicast and reserved ones stay among themselves
    host = _ip_ok(x)
    return ".".join(map(str, walk(key, "ipv4", x, 1 << 32, lambda n: _ip_ok(n) == host, back).to_bytes(4, "big")))


def date(key: bytes, value: str, back: bool) -> str | None:
    """Year first, or month/day/year, or day.month.year; day/month/year where the first number can't be a month.

    A date stays within its format, which is the order, the separator and the number of digits of day and month: one
    digit is a format of its own, of the dates that need no more. Years 1900 to 2099 and the others stay among themselves.
    """
    sep = re.search(r"\D", value)[0]
    parts = value.split(sep)
    if len(parts) != 3:
        return None  # two kinds of separators
    a, b, c = map(int, parts)
    day_first = sep == "." or sep == "/" and a > 12
    year, month, day = (a, b, c) if sep == "-" else (c, b, a) if day_first else (c, a, b)
    try:
        x = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    digits = [len(p) for p in parts]
    wide_day, wide_month = (digits[2], digits[1]) if sep == "-" else (digits[0], digits[1]) if day_first else (digits[1], digits[0])
    near = FIRST_DAY <= x <= LAST_DAY
    low, size = (FIRST_DAY, LAST_DAY - FIRST_DAY + 1) if near else (1, DAYS)

    def ok(n: int) -> bool:
        d = datetime.date.fromordinal(low + n)
        # month/day and day/month texts are told apart by the first number, so each stays within its own kind
        return (near or not FIRST_DAY <= low + n <= LAST_DAY) and (wide_day > 1 or d.day < 10) and (wide_month > 1 or d.month < 10) and (sep != "/" or not day_first or d.day > 12)

    kind = f"date{sep}{'d' if day_first else 'm'}{wide_day}{wide_month}{'' if near else 'far'}"
    new = datetime.date.fromordinal(low + walk(key, kind, x - low, size, ok, back))
    y, m, d = f"{new.year:04d}", f"{new.month:0{wide_month}d}", f"{new.day:0{wide_day}d}"
    return sep.join((y, m, d) if sep == "-" else (d, m, y) if day_first else (m, d, y))


def _characters(key: bytes, tweak: str, value: str, alphabets: list[str], back: bool) -> str:
    """value with each character permuted within its alphabet, all of them together; others stay."""
    kinds = [next((a for a in alphabets if c in a), "") for c in value]
    x, size = 0, 1
    for c, a in zip(value, kinds, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join(a[:1] or c for c, a in zip(value, kinds, strict=True))
    x = permute(key, f"{tweak}/{shape}", x, size, back) if size > 1 else x
    out = []
    for c, a in zip(reversed(value), reversed(kinds), strict=True):
        if a:
            x, i = divmod(x, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


_LOWER, _UPPER, _TEN = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def email(key: bytes, value: str, back: bool) -> str:
    local, _, domain = value.rpartition("@")
    return _characters(key, "email", local, [_LOWER, _UPPER, _TEN], back) + "@" + domain


def access_key(key: bytes, value: str, back: bool) -> str:
    return value[:4] + _characters(key, "key", value[4:], [_UPPER + _TEN], back)


_MAKERS = {"card": card, "ssn": ssn, "phone": phone, "ipv4": ipv4, "date": date, "email": email, "key": access_key}


@functools.lru_cache(maxsize=50_000)
def pseudonym(key: bytes, kind: str, value: str, back: bool = False) -> str | None:
    """The pseudonym of a value, or with back the value of a pseudonym; None if the value is not valid."""
    return _MAKERS[kind](key, value, back)


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind."""
    counts: dict[str, int] = {}

    def put(kind: str, value: str) -> str:
        new = pseudonym(key, kind, value, back)
        if new is None:
            return value
        counts[kind] = counts.get(kind, 0) + 1
        return new

    def numbers(part: str) -> str:
        out, last = [], 0
        for m in _RUN.finditer(part):
            if m["run"] and (spans := card_spans(m[0])):
                new = cards(key, m[0], spans, back)
                counts["card"] = counts.get("card", 0) + len(spans)
                for a, b in spans:
                    out += [_NUMBER.sub(lambda n: put(n.lastgroup, n[0]), part[last : m.start() + a]), new[a:b]]
                    last = m.start() + b
        return "".join([*out, _NUMBER.sub(lambda n: put(n.lastgroup, n[0]), part[last:])])

    if any(c in text for c in _TEN) or "AKIA" in text:
        # e-mail addresses are set apart first: their digits are no numbers
        out, last = [], 0
        for m in _EMAIL.finditer(text) if "@" in text else ():
            out += [numbers(text[last : m.start()]), put("email", m[0])]
            last = m.end()
        return "".join([*out, numbers(text[last:])]), counts
    if "@" in text:
        text = _EMAIL.sub(lambda m: put("email", m[0]), text)
    return text, counts


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_card, ..., n_values) for every row of docs.

    Null texts stay null, with counts of 0; empty ones stay empty. Repeated rows get equal results, an empty
    table none; other columns are not read; texts of any length are treated whole. The key stays with the tasks.
    """
    schema = "doc_id long, text string, " + "".join(f"n_{k} long, " for k in KINDS) + "n_values long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                done = [pseudonymise(t, key) if t else (t, {}) for t in part.column(1).to_pylist()]
                counts = [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS]
                cols = [part.column(0), pa.array([t for t, _ in done], pa.string()), *counts, pa.array([sum(c.values()) for _, c in done], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", *(f"n_{k}" for k in KINDS), "n_values"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
