"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Found in texts, validated and replaced:

``card``    13 to 19 digits that pass the Luhn check, in one group or in several with spaces or hyphens between
``phone``   +, country code and 7 to 14 further digits with usual punctuation; ddd-ddd-dddd and (ddd) ddd-dddd
``iban``    account numbers of the countries in ``IBAN_LENGTHS`` that pass their check, spaced or not
``ip``      IPv4 addresses (each number at most 255)
``email``   addresses; the digits and letters of the name are permuted, and so the host's first label
``ssn``     ddd-dd-dddd outside of the ranges never given out
``date``    ISO (2024-01-31) and d/m/y or m/d/y dates that are days of the calendar
``digits``  other numbers of 9 to 19 digits that stand alone

At every place the kinds are tried in turn. Where digits go on in further groups, the parts that end with a group are
tried, so neither a code nor another number behind a card or phone hides it; and where nothing fits, the
next group is tried.

Each value is a point of the finite set of values of its kind and format, and is moved by a
permutation of that set: a Feistel network of ``ROUNDS`` keyed rounds over numbers, walked on
until it lands inside the set again (cycle walking). So a pseudonym has the format of its value (a
card number passes the Luhn check, a date is a day of the calendar, punctuation stays),
equal values get equal pseudonyms in all documents however they are punctuated, different ones get
different ones, and who holds the key can go back.

The way back reads a text as the way there does. It is exact but for digit groups that stand ahead of a replaced
number in one row of groups: in one of about ten such rows they and the new digits pass for a card together.

Defined results: null stays null, empty stays empty; a text without such data stays as it is;
numbers that fail validation as one kind are tried as the next; repeated rows come out
alike; tables may be empty; other columns pass through, whatever their names.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.registry import query, table

ROUNDS = 8
#: Days that dates are moved among.
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


class Feistel:
    """Keyed permutations of ranges of numbers."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back

    def _round(self, tweak: str, n: int, i: int, half: int) -> int:
        data = f"{tweak}/{n}/{i}/{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def _once(self, x: int, low: int, tweak: str, n: int) -> int:
        """Alternating Feistel over low x low: the halves take turns in being added to."""
        a, b = divmod(x, low)
        for i in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            if self.back:
                a, b = (b - self._round(tweak, n, i, a)) % low, a
            else:
                a, b = b, (a + self._round(tweak, n, i, b)) % low
        return a * low + b

    def permute(self, x: int, n: int, tweak: str) -> int:
        """Where the permutation of ``range(n)`` under ``tweak`` sends ``x``."""
        low = isqrt(n - 1) + 1
        while True:
            x = self._once(x, low, tweak, n)
            if x < n:
                return x

    def digits(self, value: str, tweak: str) -> str:
        return f"{self.permute(int(value), 10 ** len(value), f'{tweak}{len(value)}'):0{len(value)}d}"


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced by others, in order."""
    at = iter(digits)
    return "".join(next(at) if c.isdigit() else c for c in shape)


def _plain(text: str) -> str:
    return re.sub(r"\D", "", text)


def _is_card(number: str) -> bool:
    return 13 <= len(number) <= 19 and luhn_digit(number[:-1]) == number[-1]


#: Sizes of the groups in which cards are usually printed (fixed values).
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 5))


def _card_ends(value: str) -> list[int]:
    """Where a card number at the beginning of a row of digit groups can end, the usual groups first."""
    ends = [m.end() for m in re.finditer(r"\d+", value)]
    sizes = [len(g) for g in re.findall(r"\d+", value)]
    usual = [len(g) - 1 for g in CARD_GROUPS if tuple(sizes[: len(g)]) == g]
    return [ends[i] for i in dict.fromkeys([*usual, *range(len(ends))])]


def _card_at(value: str) -> int | None:
    """Where the card number ends that stands at the beginning of a row of digit groups."""
    return next((end for end in _card_ends(value) if _is_card(_plain(value[:end]))), None)


def card(value: str, feistel: Feistel) -> str | None:
    """Walked on past numbers of which a part would be taken for the card."""
    if _card_at(value) != len(value):
        return None
    number = _plain(value)
    while True:
        payload = feistel.digits(number[:-1], "card")
        number = payload + luhn_digit(payload)
        if _card_at(new := _fill(value, number)) == len(value):
            return new


def phone(value: str, feistel: Feistel) -> str | None:
    number = _plain(value)
    if not value.startswith("+"):  # a number of ten digits belongs to country 1
        return _fill(value, feistel.digits(number, "phone1"))
    if not 8 <= len(number) <= 15:
        return None
    code = re.match(r"\+\d{1,3}(?=\D)", value)  # a country code that stands apart stays
    kept = len(_plain(code.group())) if code else 1
    return _fill(value, number[:kept] + feistel.digits(number[kept:], "phone" + number[:kept]))


#: Characters of an account number in each country (fixed values).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def _remainder(account: str, country: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def iban(value: str, feistel: Feistel) -> str | None:
    """Digits and letters behind country and check are moved as one number; the check follows."""
    plain = value.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if len(plain) != IBAN_LENGTHS.get(country) or _remainder(account, country, check) != 1:
        return None
    radix = [10 if c.isdigit() else 26 for c in account]
    x, n = 0, 1
    for c, r in zip(account, radix, strict=True):
        x, n = x * r + (int(c) if r == 10 else ord(c) - 65), n * r
    shape = country + "".join("9" if r == 10 else "A" for r in radix)
    x, out = feistel.permute(x, n, f"iban{shape}"), []
    for r in reversed(radix):
        x, d = divmod(x, r)
        out.append(str(d) if r == 10 else chr(65 + d))
    account = "".join(reversed(out))
    signs = iter(country + f"{98 - _remainder(account, country, '00'):02d}" + account)
    return "".join(c if c == " " else next(signs) for c in value)


def ip(value: str, feistel: Feistel) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if any(p > 255 for p in parts):
        return None
    moved = feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, moved.to_bytes(4, "big")))


def _name(text: str, feistel: Feistel) -> str:
    """Lower-case letters and digits moved as one number; other signs stay where they are."""
    signs = [c for c in text.lower() if c in _LETTERS]
    if not signs:
        return text
    x = 0
    for c in signs:
        x = x * 36 + _LETTERS.index(c)
    x, out = feistel.permute(x, 36 ** len(signs), f"name{len(signs)}"), []
    for _ in signs:
        x, r = divmod(x, 36)
        out.append(_LETTERS[r])
    at = iter(reversed(out))
    return "".join(next(at) if c in _LETTERS else c for c in text.lower())


def email(value: str, feistel: Feistel) -> str | None:
    name, _, host = value.rpartition("@")
    first, _, rest = host.partition(".")
    return f"{_name(name, feistel)}@{_name(first, feistel)}.{rest.lower()}"


def ssn(value: str, feistel: Feistel) -> str | None:
    number = _plain(value)

    def real(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"

    if not real(number):
        return None
    number = feistel.digits(number, "ssn")
    while not real(number):
        number = feistel.digits(number, "ssn")
    return _fill(value, number)


def _move_day(day: date, feistel: Feistel) -> date:
    span = (LAST_DAY - FIRST_DAY).days + 1
    return FIRST_DAY + timedelta(days=feistel.permute((day - FIRST_DAY).days, span, "date"))


def day(value: str, feistel: Feistel) -> str | None:
    texts = re.split(r"\D", value)
    a, b, c = (int(x) for x in texts)
    iso = len(texts[0]) == 4
    year, month, dom = (a, b, c) if iso else (c, b, a)
    american = not iso and month > 12
    if american:
        month, dom = dom, month
    if not FIRST_DAY.year <= year <= LAST_DAY.year or not 1 <= month <= 12 or not 1 <= dom <= calendar.monthrange(year, month)[1]:
        return None
    sign = re.search(r"\D", value).group()
    moved = date(year, month, dom)
    while True:
        moved = _move_day(moved, feistel)
        if iso:
            return f"{moved.year:04d}{sign}{moved.month:02d}{sign}{moved.day:02d}"
        parts = (moved.month, moved.day) if american else (moved.day, moved.month)
        # a part of one digit stays so, and which of month and day comes first shows only where one is above 12: walk on
        # to a day that can be written like this one
        if all(len(t) == 2 or p < 10 for t, p in zip(texts, parts, strict=False)) and not (american and moved.day <= 12):
            return sign.join(f"{p:0{len(t)}d}" for t, p in zip(texts, (*parts, moved.year), strict=True))


def number(value: str, feistel: Feistel) -> str | None:
    """A number that is no card's, so walked on past those that are."""
    value = feistel.digits(value, "digits")
    while len(value) >= 13 and luhn_digit(value[:-1]) == value[-1]:
        value = feistel.digits(value, "digits")
    return value


_EDGE, _END = r"(?<![\w.+-])", r"(?![\w-]|\.\d)"
#: Kinds told by one pattern, in the order in which they are tried: name, pattern, replacement.
KINDS: list[tuple[str, re.Pattern, Callable[[str, Feistel], str | None]]] = [
    ("date", re.compile(_EDGE + r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})" + _END), day),
    ("ssn", re.compile(_EDGE + r"\d{3}-\d{2}-\d{4}" + _END), ssn),
    ("ip", re.compile(_EDGE + r"\d{1,3}(?:\.\d{1,3}){3}" + _END), ip),
    ("phone", re.compile(r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}" + _END), phone),
]
_DIGITS = re.compile(_EDGE + r"\d{9,19}" + _END)
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_NAME_SIGN = re.compile(r"[A-Za-z0-9._%+-]")
#: Rows of digit groups in which a card or phone may stand; behind a hyphen only if digits stand before it.
_GROUPS = re.compile(r"(?<![\w.+])(?<![A-Za-z_]-)\d+(?:[ -]\d+)*")
_GROUPS_END = re.compile(r"(?!\w|\.\d|-[A-Za-z_])")
_PHONE = re.compile(r"(?<![\w+])\+\d+(?:[ .-]?\(?\d+\)?)*")
_PHONE_GROUP = re.compile(r"\d+\)?")
_DIGIT_GROUP = re.compile(r"\d+")
#: Digits by which a number with country code is complete, if a group ends there.
PHONE_DIGITS = 11
_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}")
#: Places at which something may begin: numbers where a digit, + or ( stands, addresses around an @.
_SEED = re.compile(r"[+(0-9@]")


def _phone_end(text: str, at: int) -> int | None:
    """Where the phone number with country code at ``at`` ends: at the first group that makes it complete, else the last."""
    row = _PHONE.match(text, at)
    if not row:
        return None
    best, digits, groups = None, 0, 0
    for group in _PHONE_GROUP.finditer(text, at, row.end()):
        digits, groups = digits + len(_plain(group.group())), groups + 1
        if digits > 15:
            break
        if digits >= 8 and _GROUPS_END.match(text, group.end()):
            best = group.end()
            if digits >= PHONE_DIGITS:
                break
    return best


def _iban_end(text: str, at: int) -> int | None:
    """Where the account number at ``at`` ends, by its country's length."""
    row = _IBAN.match(text, at)
    left = IBAN_LENGTHS.get(text[at : at + 2]) if row else None
    if left is None:
        return None
    for i in range(at, row.end()):
        left -= text[i] != " "
        if left == 0:
            return i + 1 if not re.match(r"\w", text[i + 1 : i + 2]) else None
    return None


Hit = tuple[str, int, int, str]


class Finder:
    """Personal data and its pseudonyms, under one key."""

    def __init__(self, key: bytes, back: bool = False):
        feistel = Feistel(key, back)
        self._change = {name: change for name, _, change in KINDS} | {"email": email, "card": card, "iban": iban, "digits": number}
        # values recur, as the same people do
        self._new = lru_cache(maxsize=100_000)(lambda name, value: self._change[name](value, feistel))

    def _spans(self, text: str, at: int) -> Iterator[tuple[str, int, int]]:
        """(kind, start, end) of what may stand at ``at``, in the order of trying."""
        if m := _EMAIL.match(text, at):
            yield "email", at, m.end()
        if end := _iban_end(text, at):
            yield "iban", at, end
        for name, pattern, _ in KINDS:
            if m := pattern.match(text, at):
                yield name, at, m.end()
        if row := _GROUPS.match(text, at):
            for end in _card_ends(row.group()):
                if _GROUPS_END.match(text, at + end):
                    yield "card", at, at + end
        if end := _phone_end(text, at):
            yield "phone", at, end
        if m := _DIGITS.match(text, at):
            yield "digits", at, m.end()

    def hit(self, text: str, at: int) -> Hit | None:
        """What stands at ``at``: (kind, start, end, pseudonym)."""
        for name, start, end in self._spans(text, at):
            if (new := self._new(name, text[start:end])) is not None:
                return name, start, end, new
        return None

    def hits(self, text: str) -> Iterator[Hit]:
        """All that is found, in order, not overlapping."""
        done = skipped = 0
        addresses = "@" in text
        for seed in _SEED.finditer(text):
            at = seed.start()
            if at < max(done, skipped):
                continue
            if addresses:  # an address may have begun before
                while at > done and _NAME_SIGN.match(text, at - 1):
                    at -= 1
            if at >= done + 2 and text[at].isdigit() and text[at - 1].isupper() and text[at - 2].isupper():
                at -= 2  # an account number begins with its country
            hit = self.hit(text, at)
            while hit is None and at < seed.start():
                at += 1
                hit = self.hit(text, at)
            if hit:
                done = hit[2]
                yield hit
            elif text[at].isdigit():  # on to the next group
                skipped = _DIGIT_GROUP.match(text, at).end()


@lru_cache(maxsize=4)
def finder(key: bytes, back: bool = False) -> Finder:
    return Finder(key, back)


def pseudonymize(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its personal data replaced, and (kind, start, end) of each in the old text."""
    parts: list[str] = []
    found: list[tuple[str, int, int]] = []
    at = 0
    for kind, start, end, new in finder(key, back).hits(text):
        parts += [text[at:start], new]
        found.append((kind, start, end))
        at = end
    parts.append(text[at:])
    return "".join(parts), found


def pseudonymized(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and its ``spans`` (kind, start, end in the
    old text). With ``back`` the way is undone."""
    source = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, kinds = [], []
            for value in batch.column(1).to_pylist():
                if value is None:
                    new.append(None)
                    kinds.append([])
                    continue
                changed, found = pseudonymize(value, key, back)
                new.append(changed)
                kinds.append([{"kind": k, "start": a, "end": z} for k, a, z in found])
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(new, pa.string()), pa.array(kinds, pa.list_(span))], names=["row", "new", "pii"]
            )

    row = source.schema["row"].dataType.simpleString()
    out = source.mapInArrow(run, f"row {row}, new string, pii array<struct<kind: string, start: int, end: int>>")
    columns = [(F.col("new") if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    return out.select(*columns, F.col("pii").alias(spans))


#: The key of the query; a real run brings its own from a secret store.
QUERY_KEY = b"rollcall"


@query("op9_pii_pseudonyms")
def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal data, and where it stood."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymized(docs, QUERY_KEY).select("doc_id", "text", F.size("pii").alias("n_pii"), "pii")
