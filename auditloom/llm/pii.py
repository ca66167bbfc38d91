"""Format-preserving Feistel pseudonyms for personal data.

Validated values are permuted with a key inside their own format: the digits of a number, an
address or a date go through a Feistel network over exactly the values of that format, so a
pseudonym is valid again, has the same layout, and equal values get equal pseudonyms in every
document. Nothing is stored or looked up, so the work needs no shuffle and can be undone with
the key (``forward=False``).

Kinds, in the order in which they claim text:

- ``email``: local part and first domain label; letters and digits stay letters and digits of
  their script, case and block of 128 code points. Parts longer than an address may have (64
  before the sign, 63 in a label, 8 labels) are no address and are left alone
- ``iban``: checked modulo 97; digits after the bank's country are permuted, check digits redone
- ``ipv4``: four numbers to 255, of any address
- ``date``: a real day of 1900 to 2099 as year-month-day (also with slashes), day.month.year, or
  month/day/year (day/month/year where that is no day); one digit stays one digit
- ``card``: 13 to 19 digits that pass the Luhn check, perhaps in groups; check digit redone
- ``phone``: ``+`` and country code with 7 to 14 more digits, or 10 digits as (123) 456-7890
- ``ssn``: 123-45-6789 with a number that can be issued

Other digit runs are left alone, and no value stays as it is (but one whose every letter is
alone in its block). Edge cases: a null text stays null, an empty one empty; a null id is kept;
repeated rows are treated as they stand; texts of any length are taken whole, in time linear in
their length; other columns are kept; no rows give none.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


@lru_cache(100_000)
def _round(key: bytes, kind: str, i: int, value: int, size: int) -> int:
    data = f"{kind}|{i}|{value:x}|{size:x}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=16).digest(), "big") % size


def _network(value: int, size: int, key: bytes, kind: str, forward: bool) -> int:
    """A keyed permutation of 0 .. size - 1: an unbalanced network over two halves whose
    product is just over ``size``; a value that leaves the range goes in again."""
    left = math.isqrt(size - 1) + 1
    right = -(-size // left)
    x = value
    while True:
        a, b = divmod(x, right)
        for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            sign = 1 if forward else -1
            if i % 2 == 0:
                a = (a + sign * _round(key, kind, i, b, left)) % left
            else:
                b = (b + sign * _round(key, kind, i, a, right)) % right
        x = a * right + b
        if x < size:
            return x


def feistel(value: int, size: int, key: bytes, kind: str, forward: bool = True) -> int:
    """A keyed permutation of 0 .. size - 1 that leaves no value in place (sizes over 1).

    The network turned round, a keyed step, the network: a step has no fixed point, and so
    neither has the whole.
    """
    if size < 2:
        return value
    step = 1 + _round(key, kind, ROUNDS, size, size - 1)
    inner = _network(value, size, key, kind, False)
    return _network((inner + (step if forward else -step)) % size, size, key, kind, True)


#: ASCII characters that stay within their class.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASS = {c: group for group in CLASSES for c in group}


@lru_cache(10_000)
def _class_of(c: str) -> str | None:
    """The characters that ``c`` may become: those of its kind in its block of 128 code points."""
    if c < "\x80":
        return _CLASS.get(c)
    if not c.isalnum():
        return None
    kind, first = unicodedata.category(c), ord(c) & ~127
    return "".join(d for d in map(chr, range(first, first + 128)) if d.isalnum() and unicodedata.category(d) == kind)


def _characters(text: str, key: bytes, kind: str, forward: bool) -> str:
    """Every digit and letter permuted within its class, all of them as one number."""
    groups = [_class_of(c) for c in text]
    value, size = 0, 1
    for c, group in zip(text, groups, strict=True):
        if group:
            value, size = value * len(group) + group.index(c), size * len(group)
    value = feistel(value, size, key, f"{kind}{size:x}", forward)
    out = []
    for c, group in zip(reversed(text), reversed(groups), strict=True):
        if group:
            value, k = divmod(value, len(group))
            c = group[k]
        out.append(c)
    return "".join(reversed(out))


def _refill(layout: str, digits: str) -> str:
    """The digits of ``layout`` replaced one by one."""
    left = iter(digits)
    return "".join(next(left) if c in CLASSES[0] else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in CLASSES[0])


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(m, key, forward):
    local, at, rest = m[0].partition("@")
    label, dot, tail = rest.partition(".")
    new = _characters(f"{local}@{label}", key, "email", forward)
    return new + dot + tail


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _iban(m, key, forward):
    plain = m[0].replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(account) <= 30 or int(check) != _iban_check(country, account):
        return None
    new = _characters(account, key, "iban" + country, forward)
    left = iter(f"{country}{_iban_check(country, new):02d}{new}")
    return "".join(c if c == " " else next(left) for c in m[0])


def _ipv4(m, key, forward):
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4", forward)
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


@lru_cache(16)
def _days(short_month: bool, short_day: bool, late: bool) -> tuple[list[int], dict[int, int]]:
    """The days of a layout, and the place of each: months or days of one digit, days after the twelfth."""
    days = []
    for k in range(_DAYS):
        date = _FIRST + datetime.timedelta(days=k)
        if (not short_month or date.month < 10) and (not short_day or date.day < 10) and (not late or date.day > 12):
            days.append(k)
    return days, {day: i for i, day in enumerate(days)}


def _date(m, key, forward):
    order = "ymd" if m["ymd"] or m["yms"] else "dmy" if m["dmy"] else "mdy"
    numbers = re.findall("[0-9]+", m[0])
    if order == "mdy" and int(numbers[0]) > 12:
        order = "dmy"  # no such month, so it is the other way round, and stays so
    part = dict(zip(order, numbers, strict=True))
    days, places = _days(len(part["m"]) == 1, len(part["d"]) == 1, order == "dmy" and bool(m["mdy"]))
    try:
        day = places.get((datetime.date(*(int(part[c]) for c in "ymd")) - _FIRST).days)
    except ValueError:
        return None
    if day is None:
        return None
    kind = "date" if len(days) == _DAYS else f"date{len(days)}"
    new = _FIRST + datetime.timedelta(days=days[feistel(day, len(days), key, kind, forward)])
    value = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(part['m'])}d}", "d": f"{new.day:0{len(part['d'])}d}"}
    return _refill(m[0], "".join(value[c] for c in order))


def _card(m, key, forward):
    digits = _digits(m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{feistel(int(digits[:-1]), 10**n, key, f'card{n}', forward):0{n}d}"
    return _refill(m[0], f"{body}{luhn(body)}")


def _phone(m, key, forward):
    country = m["country"] or ""
    rest = m[0][len(country) :]
    digits = _digits(rest)
    if not 7 <= len(digits) <= 14:
        return None
    n = len(digits)
    return country + _refill(rest, f"{feistel(int(digits), 10**n, key, f'phone{country}{n}', forward):0{n}d}")


def _ssn(m, key, forward):
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(feistel(value, 898 * 99 * 9999, key, "ssn", forward), 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Kind, pattern, function giving the pseudonym or None for what is no valid value.
KINDS = [
    ("email", r"(?<![\w.+-])[\w.+-]{0,63}(?<=\w)@[^\W_](?:[\w-]{0,61}\w)?(?:\.[\w-]{1,63}){0,6}\.[A-Za-z]{2,63}(?![\w-])", _email),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", _iban),
    ("ipv4", r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])", _ipv4),
    (
        "date",
        r"(?<![0-9A-Za-z.-])(?:(?P<ymd>[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})|(?<!/)(?P<yms>[0-9]{4}/[0-9]{1,2}/[0-9]{1,2})(?!/)"
        r"|(?P<dmy>[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})|(?<!/)(?P<mdy>[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?!/))(?![0-9A-Za-z]|[.-][0-9])",
        _date,
    ),
    ("card", r"(?<![0-9A-Za-z+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])", _card),
    (
        "phone",
        r"(?<![0-9A-Za-z+])(?:(?P<country>\+1)[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"
        r"|[0-9]{3}([-.])[0-9]{3}\2[0-9]{4})(?![0-9A-Za-z])",
        _phone,
    ),
    ("phone", r"(?<![0-9A-Za-z+])(?P<country>\+(?!1[^0-9])[0-9]{1,3})[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])", _phone),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])", _ssn),
]
_PATTERNS = [(kind, re.compile(pattern), f) for kind, pattern, f in KINDS]


def pseudonyms(text: str, key: bytes, forward: bool = True) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and pseudonym of every valid value, in the order of the text."""
    found: list[tuple[str, int, int, str]] = []
    taken = bytearray(len(text))
    for kind, pattern, change in _PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            if any(taken[s:e]):
                continue
            new = change(m, key, forward)
            if new is not None:
                found.append((kind, s, e, new))
                taken[s:e] = b"\1" * (e - s)
    return sorted(found, key=lambda f: f[1])


def replaced(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, s, e, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def _key(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def _candidates(texts: pa.Array) -> list[int]:
    """The rows with a digit or an at sign; no other text holds a value."""
    return np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False))).tolist()


def find_values(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: its id, ``text`` with pseudonyms, and ``found``: kind, start and end
    (code points of the given text) and pseudonym of each value."""
    secret = _key(key)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            out, found = texts.to_pylist(), [[] for _ in range(len(texts))]
            for i in _candidates(texts):
                some = pseudonyms(out[i], secret)
                out[i] = replaced(out[i], some)
                found[i] = [dict(zip(("kind", "start", "end", "pseudonym"), f, strict=True)) for f in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, texts.type), pa.array(found, found_type)], ["id", "text", "found"]
            )

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, found array<struct<kind: string, start: long, end: long, pseudonym: string>>"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", forward: bool = True) -> DataFrame:
    """The documents, all columns, with the values in ``text_col`` replaced by pseudonyms
    (``forward=False``: pseudonyms by the values)."""
    secret, place = _key(key), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            if rows := _candidates(texts):
                values = texts.to_pylist()
                for i in rows:
                    values[i] = replaced(values[i], pseudonyms(values[i], secret, forward))
                batch = batch.set_column(place, batch.schema.field(place), pa.array(values, texts.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
