"""Personal data behind format-preserving Feistel pseudonyms.

A value that passes its validation is read as a number of its format's domain (digits, letters and days keep their
kinds and places), permuted by a keyed Feistel network and written in the same format. The permutation depends on key
and format alone, so equal values have equal pseudonyms in all documents and different values never share one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

ROUNDS = 8
#: Days that dates are permuted within.
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

_VALUE = re.compile(
    r"""(?<![0-9A-Za-z_.+-])(?:
      (?P<ip>\d{1,3}(?:\.\d{1,3}){3})
    | (?P<iso>\d{4}(?P<mark>[-/])\d{2}(?P=mark)\d{2}(?=T\d|(?![0-9A-Za-z_]))) | (?P<dmy>\d{1,2}(?P<dot>[./])\d{1,2}(?P=dot)\d{4})
    | (?P<ssn>\d{3}-\d{2}-\d{4})
    | (?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4} | \(\d{3}\)[ ]?\d{3}-\d{4} | \d{3}-\d{3}-\d{4})
    | (?P<card>\d(?:[ -]?\d){12,18})
    | (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)
    )(?:(?<=\d)(?=T\d)|(?![0-9A-Za-z_]))""",
    re.VERBOSE,
)
KINDS = ("ip", "iso", "dmy", "ssn", "phone", "card", "iban")
_LOCAL = re.compile(r"[A-Za-z0-9._%+À-ÿ-]")
_DOMAIN = re.compile(r"[A-Za-z0-9À-ÿ-]+(?:\.[A-Za-z0-9À-ÿ-]+)*\.[A-Za-zÀ-ÿ]{2,}")
_TRIGGER = re.compile(r"[0-9@]")
#: Calling codes of one and two digits; all others have three.
ONE_DIGIT_CODES = ("1", "7")
TWO_DIGIT_CODES = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
#: The characters that stand for each other in a pseudonym; capitals go with their lower-case alphabet.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ßÿ")
_PLACES = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}
#: Characters of an e-mail address that are permuted together, at most.
PIECE = 64
#: Up to this size of a domain a pseudonym is made by a permutation without fixed points.
SMALL_DOMAIN = 1 << 20


def _rounds(value: int, size: int, key: bytes, tweak: str, numbers: range, undo: bool = False) -> int:
    """Feistel rounds over the next even number of bits, walked back into range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in numbers:
            if undo:
                left, right = right, left
            block = blake2b(f"{tweak}/{size:x}/{r}/{right:x}".encode(), key=key, digest_size=(half + 7) // 8 + 8).digest()
            mixed = left ^ (int.from_bytes(block, "big") & mask)
            left, right = (mixed, right) if undo else (right, mixed)
        value = left << half | right
        if value < size:
            return value


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size); in small domains, where chance would leave values as they are, one without
    fixed points: a step around the circle on which the Feistel network has laid the values."""
    if size < 2:
        return value
    value = _rounds(value, size, key, tweak, range(ROUNDS))
    if size > SMALL_DOMAIN:
        return value
    return _rounds((value + 1) % size, size, key, tweak, range(ROUNDS - 1, -1, -1), undo=True)


def _permute_text(text: str, key: bytes, tweak: str) -> str:
    """Digits become digits and letters letters of their alphabet, in their places and case; all else stays."""
    places = [_PLACES.get(c.lower()) for c in text]
    value, size = 0, 1
    for p in places:
        if p:
            value, size = value * len(ALPHABETS[p[0]]) + p[1], size * len(ALPHABETS[p[0]])
    value = permute(value, size, key, tweak + "".join("-" if p is None else str(p[0]) for p in places))
    out = []
    for c, p in zip(reversed(text), reversed(places), strict=True):
        if p:
            value, at = divmod(value, len(ALPHABETS[p[0]]))
            new = ALPHABETS[p[0]][at]
            c = new.upper() if c.isupper() else new
        out.append(c)
    return "".join(reversed(out))


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return luhn_digit(digits[:-1]) == digits[-1]


def _number(digits: str, key: bytes) -> str:
    """A number with a valid check digit gets one with a valid check digit, any other one without."""
    if luhn_digit(digits[:-1]) == digits[-1]:
        payload = _permute_text(digits[:-1], key, "card")
        return payload + luhn_digit(payload)
    while True:
        digits = _permute_text(digits, key, "number")
        if luhn_digit(digits[:-1]) != digits[-1]:
            return digits


def _ssn(digits: str, key: bytes) -> str | None:
    """Permutes among the numbers that are given out: area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    n, serial = divmod(permute(n, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_digits(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _day(year: int, month: int, day: int, key: bytes, widths: tuple[int, int] = (2, 2)) -> date | None:
    """The pseudonym of a day whose month and day take so many digits, among the days that do so too."""
    try:
        n = date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    while True:
        n = FIRST_DAY + permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "day")
        made = date.fromordinal(n)
        if made.month < 10 ** widths[0] and made.day < 10 ** widths[1]:
            return made


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym in its own format; None when it is not valid for its kind."""
    if kind == "ip":
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "iso":
        day = _day(int(value[:4]), int(value[5:7]), int(value[8:]), key)
        return day and day.isoformat().replace("-", value[4])
    if kind == "dmy":
        mark = "." if "." in value else "/"
        parts = value.split(mark)
        a, b, y = map(int, parts)
        month_first = a <= 12 < b
        widths = tuple(map(len, parts[:2]))
        day = _day(y, *((a, b) if month_first else (b, a)), key, widths if month_first else widths[::-1])
        if day is None:
            return None
        made = (day.month, day.day) if month_first else (day.day, day.month)
        return mark.join([*(f"{n:0{w}d}" for n, w in zip(made, widths, strict=True)), str(day.year)])
    digits = re.sub(r"\D", "", value)
    if kind == "ssn":
        return _ssn(digits, key)
    if kind == "phone":
        if not 9 <= len(digits) <= 15:
            return None
        country = 0
        if value[0] == "+":
            country = 1 if digits.startswith(ONE_DIGIT_CODES) else 2 if digits.startswith(TWO_DIGIT_CODES) else 3
        return _fill(value, digits[:country] + _permute_text(digits[country:], key, "phone"))
    if kind in ("card", "number"):
        return _fill(value, _number(digits, key))
    if kind == "iban":
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_digits(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = _permute_text(plain[4:], key, "iban")
        source = iter(plain[:2] + _iban_digits(plain[:2], rest) + rest)
        return "".join(c if c == " " else next(source) for c in value)
    # a piece at a time, so that an endless run before an @ takes time in proportion
    return "".join(_permute_text(value[at : at + PIECE], key, f"email{at}") for at in range(0, len(value), PIECE))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and _DOMAIN.match(text, at + 1):
            yield start, at
        at = text.find("@", at + 1)


def find_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans to replace, in order; of an e-mail address the part before the @."""
    if not _TRIGGER.search(text):
        return []
    emails, found = list(_emails(text)), []
    at = 0
    for m in _VALUE.finditer(text):  # both lists are in order, and spans of one do not overlap
        while at < len(emails) and emails[at][1] <= m.start():
            at += 1
        if at == len(emails) or m.end() <= emails[at][0]:
            kind = next(k for k in KINDS if m[k] is not None)
            if kind == "card" and not _is_card(m[kind]):
                kind = "number"
            found.append((m.start(), m.end(), kind))
    return sorted(found + [(a, b, "email") for a, b in emails])


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with pseudonyms, and what was replaced: kind, start and end in the new text, pseudonym."""
    if not text:
        return text, []
    cached = _cached(key)
    out, done, spans, length = [], 0, [], 0
    for start, end, kind in find_values(text):
        new = cached(kind, text[start:end])
        if new is None or new == text[start:end]:  # not valid, or nothing in it that could change
            continue
        out += [text[done:start], new]
        length += start - done
        spans.append({"kind": {"iso": "date", "dmy": "date"}.get(kind, kind), "start": length, "end": length + len(new), "pseudonym": new})
        length += len(new)
        done = end
    return ("".join([*out, text[done:]]) if spans else text), spans


@lru_cache(4)
def _cached(key: bytes):
    return lru_cache(50_000)(lambda kind, value: pseudonym(kind, value, key))


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, text with pseudonyms, n_values, values (kind, start, end, pseudonym).

    Values are e-mail addresses (the part before the @; the domain stays), telephone and card numbers (13 to 19 digits
    with a valid check digit), IPv4 addresses, IBANs, US social security numbers and dates from 1900 to 2099 as 2024-02-29,
    2024/02/29, 29.2.2024 or 2/29/2024, also before a time of day. A run of 13 to 19 digits without a valid check digit may
    be an account or a mistyped card: it is replaced under a kind of its own, `number`. A pseudonym is valid by the rules
    that found its value. IPv6 addresses, telephone numbers without + or American grouping and years of two digits stay.
    A value in which nothing can change (an address of marks only) stays and is not counted. Whole texts are searched.
    Null texts stay null, empty ones empty, both without values. Repeated rows give a row each; other columns are
    ignored. The key has 1 to 64 bytes; whoever holds it can link and undo pseudonyms.
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymise(t.as_py(), key) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(v) for _, v in done], pa.int32()), pa.array([v for _, v in done], arrow)],
                ["id", "text", "n_values", "values"],
            )

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, text string, n_values int, values array<struct<kind:string,start:int,end:int,pseudonym:string>>")
