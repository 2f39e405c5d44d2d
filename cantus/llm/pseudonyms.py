"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Validated values (Luhn, calendar, octets, mod 97, ...) are numbered within the
set of all values of their format, the number is permuted by a balanced
Feistel network that walks cycles until it is inside the set again, and the
new number is written in the format of the old value.  The permutation
depends on the key and on the kind of value only, so equal values get equal
pseudonyms in all documents, however they are punctuated, and different
values stay different.
"""

from __future__ import annotations

import calendar
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import small_batches

KEY_SETTING = "spark.cantus.pii.key"
ROUNDS = 10
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
MONTHS = list(calendar.month_name)[1:]
SHORT_MONTHS = list(calendar.month_abbr)[1:]
#: Dates are permuted within the 200 years that begin at 1500, 1700, 1900, ..., so a date of any year has a pseudonym of its own era.
ERA, FIRST_ERA = 200, 1500


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    base = hashlib.blake2b(f"{tweak}|{size}".encode(), key=hashlib.sha512(key).digest(), digest_size=32).digest()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            said = bytes([r]) + right.to_bytes(width, "big")
            f = hashlib.blake2b(said, key=base, digest_size=max(8, width)).digest() if width <= 64 else hashlib.shake_256(base + said).digest(width)
            left, right = right, left ^ int.from_bytes(f, "big") & mask
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def card(s: str, key: bytes) -> str | None:
    d = _only_digits(s)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
    return _refill(s, body + str(luhn(body)))


def phone(s: str, key: bytes) -> str | None:
    """The country code stays: the digits right behind a plus sign, 1 alone for +1."""
    d = _only_digits(s)
    if not 8 <= len(d) <= 15:
        return None
    code = 0
    if s[0] == "+":
        code = 1 if d[0] == "1" else len(re.match(r"\+(\d{1,3})", s)[1])
    if len(d) - code < 6:
        return None
    rest = d[code:] if code or len(d) != 11 else d
    tweak = f"phone{d[:code] or '1'}"
    return _refill(s, d[:code] + f"{permute(int(rest), 10 ** len(rest), key, tweak):0{len(rest)}d}")


def ipv4(s: str, key: bytes) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


#: Areas of social security numbers: 001-899 without 666.
_AREAS = [a for a in range(1, 900) if a != 666]


def ssn(s: str, key: bytes) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a == 0 or a == 666 or a >= 900 or not g or not n:
        return None
    number = (_AREAS.index(a) * 99 + g - 1) * 9999 + n - 1
    number, n = divmod(permute(number, len(_AREAS) * 99 * 9999, key, "ssn"), 9999)
    return f"{_AREAS[number // 99]:03d}-{number % 99 + 1:02d}-{n + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _mixed(s: str, key: bytes, tweak: str) -> str:
    """Letters among letters and digits among digits, all places permuted together; other characters stay."""
    size, n = 1, 0
    shape = "".join("0" if c in DIGITS else "a" if c in LETTERS else c for c in s)
    for c, k in zip(s, shape, strict=True):
        if k in "0a":
            m = 10 if k == "0" else 26
            n, size = n * m + (int(c) if k == "0" else LETTERS.index(c)), size * m
    n = permute(n, size, key, f"{tweak}|{shape}")
    out = []
    for k in reversed(shape):
        if k == "0":
            n, r = divmod(n, 10)
            out.append(str(r))
        elif k == "a":
            n, r = divmod(n, 26)
            out.append(LETTERS[r])
        else:
            out.append(k)
    return "".join(reversed(out))


def iban(s: str, key: bytes) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat) != 1:
        return None
    body = _mixed(flat[4:].lower(), key, f"iban{flat[:2]}").upper()
    check = 98 - _mod97(f"{flat[:2]}00{body}")
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in s)


def email(s: str, key: bytes) -> str | None:
    """All letters and digits of the address but the top-level domain; case stays where it was."""
    name, top = s.rsplit(".", 1)
    new = _mixed(name.lower(), key, f"email|{top.lower()}")
    return "".join(n.upper() if c.isupper() else n for c, n in zip(name, new, strict=True)) + "." + top


def _day(y: int, m: int, d: int, key: bytes) -> date | None:
    """Another day of the same era: 200 years, of which the last may end at 9999."""
    try:
        old = date(y, m, d)
    except ValueError:
        return None
    first = FIRST_ERA + (y - FIRST_ERA) // ERA * ERA
    begin, end = date(max(first, 1), 1, 1), date(min(first + ERA - 1, 9999), 12, 31)
    return begin + timedelta(permute((old - begin).days, (end - begin).days + 1, key, f"date{first}"))


def iso_date(s: str, key: bytes) -> str | None:
    new = _day(*map(int, s.split("-")), key)
    return new and new.isoformat()


def dashed_date(s: str, key: bytes) -> str | None:
    """Day and month with dashes; as with dots the day comes first if both can."""
    new = short_date(s.replace("-", "."), key)
    return new and new.replace(".", "-")


def short_date(s: str, key: bytes) -> str | None:
    """Day and month by which one can be a month; the day comes first if both can."""
    a, b, y = map(int, re.split("[/.]", s))
    day_first = b <= 12
    new = _day(y, *((b, a) if day_first else (a, b)), key)
    if not new:
        return None
    first, second = (new.day, new.month) if day_first else (new.month, new.day)
    wa, wb = (len(x) for x in re.split("[/.]", s)[:2])
    sep = re.findall("[/.]", s)
    return f"{first:0{wa}d}{sep[0]}{second:0{wb}d}{sep[1]}{new.year:04d}"


def long_date(s: str, key: bytes) -> str | None:
    """A month by its name or its first three letters; the form stays."""
    words = s.replace(",", " ").replace(".", " ").split()
    month_first = not words[0].isdigit()
    m, d = (words[0], words[1]) if month_first else (words[1], words[0])
    names = MONTHS if m in MONTHS else SHORT_MONTHS
    new = _day(int(words[2]), names.index(m) + 1, int(d), key)
    if not new:
        return None
    name = names[new.month - 1] + ("." if f"{m}." in s else "")
    return f"{name} {new.day}{',' if ',' in s else ''} {new.year:04d}" if month_first else f"{new.day} {name} {new.year:04d}"


def ipv6(s: str, key: bytes) -> str | None:
    """Any valid address with at least two groups; written in its shortest form in lower case."""
    try:
        n = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(permute(n, 1 << 128, key, "ipv6")))


_MONTH = "(?:" + "|".join(MONTHS + [rf"{m}\.?" for m in SHORT_MONTHS]) + ")"
#: Kinds in the order in which they claim a place; all repeats are bounded.
NUMBERS: list[tuple[str, str, Callable]] = [
    ("ipv4", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", ipv4),
    ("iso_date", r"(?<![\w-])\d{4}-\d{2}-\d{2}(?!\d|-\d)", iso_date),
    ("short_date", r"(?<![\w/.])\d{1,2}[/.]\d{1,2}[/.]\d{4}(?!\w|[/.]\d)", short_date),
    ("long_date", rf"(?<!\w)(?:\d{{1,2}} {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}})(?!\w)", long_date),
    ("dashed_date", r"(?<![\w-])\d{1,2}-\d{1,2}-\d{4}(?!\w|-\d)", dashed_date),
    ("ipv6", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)", ipv6),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)", ssn),
    ("nanp", r"(?<!\w)\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)", phone),
    ("card", r"(?<![\w+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|-\d)", card),
    ("phone", r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)", phone),
    ("local_phone", r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\w|[.-]\d)", phone),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
]
_PATTERNS = [(kind, re.compile(p), f) for kind, p, f in NUMBERS]
_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LETTERS + DIGITS + "._%+-"
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")


class Pseudonymiser:
    """Replaces personal data in texts under one key."""

    def __init__(self, key: bytes):
        self.one = lru_cache(maxsize=50_000)(lambda f, s: f(s, key))

    @staticmethod
    def _name_begin(text: str, at: int) -> int:
        """Where the run of an address's name characters before ``at`` begins, however long it is."""
        size = 64
        while True:
            lo = max(0, at - size)
            rest = len(text[lo:at].rstrip(_NAME))
            if rest or not lo:
                return lo + rest
            size *= 4

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), in order and apart."""
        found: list[tuple[int, int, str, str]] = []
        at = text.find("@")
        while at >= 0:
            if (domain := _DOMAIN.match(text, at + 1)) and (begin := self._name_begin(text, at)) < at:
                found.append((begin, domain.end(), "email", self.one(email, text[begin : domain.end()])))
            at = text.find("@", at + 1)
        for kind, pattern, f in _PATTERNS:
            if kind == "ipv6" and text.count(":") < 2:
                continue
            for m in pattern.finditer(text):
                new = self.one(f, m[0])
                if new is not None:
                    found.append((*m.span(), kind, new))
        order = {k: i for i, k in enumerate(["email", *[k for k, _, _ in NUMBERS]])}
        out: list[tuple[int, int, str, str]] = []  # sorted; a kind that comes first keeps its place
        for x in sorted(found, key=lambda x: (order[x[2]], x[0])):
            i = bisect_left(out, x[:2], key=lambda y: y[:2])
            if (i == 0 or out[i - 1][1] <= x[0]) and (i == len(out) or x[1] <= out[i][0]):
                out.insert(i, x)
        return out

    def replace(self, text: str | None) -> tuple[str | None, Counter]:
        """The text with pseudonyms, and how many of each kind."""
        if not text or not _MAY.search(text):
            return text, Counter()
        parts, at, kinds = [], 0, Counter()
        for a, b, kind, new in self.spans(text):
            parts += [text[at:a], new]
            at = b
            kinds[kind] += 1
        return "".join([*parts, text[at:]]) if parts else text, kinds


_MAY = re.compile("[0-9@]|::")


def session_key(spark: SparkSession) -> str:
    """The setting spark.cantus.pii.key; where it is unset, a random key that is kept for the session, so that nobody can undo its pseudonyms later."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str | bytes, count: str | None = "n_pii") -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymised; ``count`` names a column for the number of values.

    Nulls and texts without personal data come back as they are.  A column
    n_chars is set to the new length where a text changed.  A column that has
    the name in ``count`` is replaced.  Rows are treated one by one, so
    repeats and empty tables are plain.
    """
    small_batches(docs.sparkSession)
    raw = key.encode() if isinstance(key, str) else key
    if not raw:
        raise ValueError("pseudonyms need a key")
    keep = [c for c in docs.columns if c != count]
    schema = docs.select(keep).schema
    if count:
        schema = schema.add(count, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(raw)
        for b in batches:
            old = b.column("text")
            new = [p.replace(t.as_py()) for t in old]
            cols = {c: b.column(c) for c in keep}
            cols["text"] = pa.array([t for t, _ in new], old.type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) if k else n for (t, k), n in zip(new, cols["n_chars"].to_pylist(), strict=True)], b.column("n_chars").type)
            if count:
                cols[count] = pa.array([sum(k.values()) for _, k in new], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.select(keep).mapInArrow(run, schema)
