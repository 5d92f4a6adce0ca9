"""Format-preserving pseudonyms for personal data and credentials.

Found values are validated, then permuted inside their own format with a keyed Feistel network:
equal values get equal pseudonyms in all documents and tables that use the key, different values
different ones, and nothing but the key has to be kept. Card numbers stay valid card numbers, dates
real dates, addresses of the same shape.

Formats: card numbers (Luhn), IBAN (remainder 97), US social security numbers, telephone numbers
(7 to 15 digits with a plus sign or brackets, 3-3-4 groups, a leading 0 and groups, or three groups and
more joined by hyphens), IPv4 and IPv6 addresses, dates from 1900 to 2099 (year first or last, days and
months of one or two digits), e-mail addresses in any script, access keys by their prefixes, bearer
tokens with a digit or a dot, and values of any length named as password, secret, token or key. A named value
runs to the next blank or quote. After an equals sign, a colon without a blank or an opening quote
every value counts; after a colon and a blank only one with a character other than the letters of a
plain word, as that is how prose reads on. Where a run of digits fails validation, its shorter prefixes and later starts are
tried, so a card is found beside other digits; a table of numbers may hold one by chance. A number in
which nothing is valid is left alone. Not told from other numbers, and so left: telephone numbers of
groups parted by blanks or dots, other than 3-3-4, without plus sign, brackets or leading 0, those of
one group, and those of two groups joined by a hyphen.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B

ROUNDS = 10
BATCH_BYTES = 4 << 20
#: Characters of a secret that are permuted together.
SECRET = 192
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

#: What may stand before the @ of an address, and what follows it.
LOCAL = re.compile(r"[\w.%+-]")
HOST = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
#: Numbers by kind, in the order in which they are tried where one may start. A card may start and end at a hyphen.
START = re.compile(r"(?<![\w@+])[+(\d]")
NUMBER = {
    kind: re.compile(("" if kind == "card" else r"(?<!\d[.-])") + f"(?:{pattern})")
    for kind, pattern in {
        "ipv4": r"\d{1,3}(?:\.\d{1,3}){3}",
        "iso_date": r"\d{4}([-/.])\d{1,2}\1\d{1,2}",
        "date": r"\d{1,2}([-/.])\d{1,2}\1\d{4}",
        "ssn": r"\d{3}-\d{2}-\d{4}",
        "card": r"(?<!\d\.)\d(?:[ -]?\d){12,18}",
        "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,8}(?:[ .-]?\d{2,4}){0,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
        r"|(?!\d{3}-\d\d-\d{4}(?![\d-])|\d{4}([-/.])\d\d\1\d\d(?![\d-])|\d\d([-/.])\d\d\2\d{4}(?![\d-]))(?:0\d{1,4}(?:[ ./-]\d{2,8}){1,5}|\d{2,5}(?:-\d{2,5}){2,5})",
    }.items()
}
AFTER, AFTER_CARD = re.compile(r"\w|[.-]\d"), re.compile(r"\w|\.\d")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)(?=[A-Z0-9]{16}(?![A-Za-z0-9]))|gh[oprsu]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza)([A-Za-z0-9_-]{16,})")
NAMED = re.compile(
    r"(?i)(?<![^\W_])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?"
    r"(?:\s*[=:]\s*(?P<q>[\"'])(?P<quoted>[^\"'\n]+)(?P=q)|\s*=\s*(?P<set>[^\s\"']+)|:(?P<told>[^\s\"']+)|\s*:\s+(?P<prose>[^\s\"']+))"
)
#: What a text holds that has a named value, or a key told by its prefix.
NAMES = ("password", "passwd", "pwd", "secret", "token", "key")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghr_", "ghu_", "github_pat_", "glpat-", "sk-", "xox", "AIza")
#: Marks that end a sentence or an element, not a value.
CLOSING = ".,;:!?)]}>&"
PLAIN_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
BEARER = re.compile(r"\bBearer\s+([A-Za-z0-9._~+/=-]+)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{3,39}(?![\w:])")


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters among which one is permuted: digits, capitals, small letters, or those of its kind near it in other scripts."""
    for known in (DIGITS, UPPER, LOWER):
        if c in known:
            return known
    if not c.isalnum():
        return ""
    kind, start = unicodedata.category(c), ord(c) & ~63
    return "".join(x for x in map(chr, range(start, start + 64)) if unicodedata.category(x) == kind)


class Permuter:
    """Keyed permutations of digit strings, letter strings and number ranges."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _half(self, label: str, step: int, other: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        data = f"{label}|{step}|{other}".encode()
        out = b"".join(hashlib.blake2b(data + bytes([i]), key=self.key, digest_size=64).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % modulus

    def number(self, label: str, value: int, size: int) -> int:
        """A permutation of ``range(size)``: Feistel over two unequal halves, walked until it lands in the range."""
        a = max(2, int(size**0.5) if size.bit_length() < 1000 else math.isqrt(size))
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for step in range(0, ROUNDS, 2):
                left = (left + self._half(label, step, right, a)) % a
                right = (right + self._half(label, step + 1, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def letters(self, label: str, text: str) -> str:
        """Every digit and letter within its own kind; other characters stay."""
        kinds = [alphabet(c) for c in text]
        size, value = 1, 0
        for c, kind in zip(text, kinds, strict=True):
            if kind:
                value, size = value * len(kind) + kind.index(c), size * len(kind)
        if size < 2:
            return text
        shape = "".join({DIGITS: "9", UPPER: "A", LOWER: "a"}.get(k, k[0]) if k else c for c, k in zip(text, kinds, strict=True))
        value, out = self.number(f"{label}|{shape}", value, size), []
        for c, kind in zip(reversed(text), reversed(kinds), strict=True):
            if kind:
                value, digit = divmod(value, len(kind))
                c = kind[digit]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, label: str, digits: str) -> str:
        return str(self.number(f"{label}|{len(digits)}", int(digits), 10 ** len(digits))).rjust(len(digits), "0")


def luhn(digits: str) -> int:
    """The digit that makes ``digits`` plus it a valid number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """Put digits back into the places of digits."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in shape)


def card(p: Permuter, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + p.digits("card" + digits[0], digits[1:-1])
    return refill(text, body + str(luhn(body)))


def ipv4(p: Permuter, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or text != ".".join(map(str, parts)) or parts[0] == 0:
        return None
    value = p.number("ipv4", ((parts[0] - 1) * 256 + parts[1]) * 65536 + parts[2] * 256 + parts[3], 255 << 24)
    return f"{(value >> 24) + 1}.{value >> 16 & 255}.{value >> 8 & 255}.{value & 255}"


_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


def _day(p: Permuter, year: int, month: int, day: int) -> datetime.date | None:
    try:
        place = datetime.date(year, month, day).toordinal() - _DAY0
    except ValueError:
        return None
    return datetime.date.fromordinal(_DAY0 + p.number("date", place, _DAYS)) if 0 <= place < _DAYS else None


def iso_date(p: Permuter, text: str) -> str | None:
    year, mark, month, _, day = re.split(r"(\D)", text)
    new = _day(p, int(year), int(month), int(day))
    return new and f"{new.year:04}{mark}{new.month:0{len(month)}}{mark}{new.day:0{len(day)}}"


def date(p: Permuter, text: str) -> str | None:
    """Day first; month first where only that is a date."""
    first, mark, second, _, last = re.split(r"(\D)", text)
    a, b, year = int(first), int(second), int(last)
    month_first = b > 12
    new = _day(p, year, a, b) if month_first else _day(p, year, b, a)
    if not new:
        return None
    x, y = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{x:0{len(first)}}{mark}{y:0{len(second)}}{mark}{new.year:04}"


def ssn(p: Permuter, text: str) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = text.replace("-", "")
    if not valid(digits):
        return None
    while not valid(digits := p.digits("ssn", digits)):
        pass  # walks along the cycle of the start, which is valid, so it ends
    return refill(text, digits)


def phone(p: Permuter, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})(?=\D)", text)
    keep = len(code[1]) if code else 0
    return refill(text, digits[:keep] + p.digits("phone" + digits[:keep], digits[keep:]))


def iban(p: Permuter, text: str) -> str | None:
    plain = text.replace(" ", "")
    rest = lambda body, head: int("".join(str(int(c, 36)) for c in body + head)) % 97
    if not 15 <= len(plain) <= 34 or rest(plain[4:], plain[:4]) != 1:
        return None
    body = p.letters("iban" + plain[:2], plain[4:])
    new = iter(plain[:2] + f"{98 - rest(body, plain[:2] + '00'):02}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def chained(p: Permuter, label: str, text: str) -> str:
    """Letters and digits permuted; long texts in pieces, each under a label of what comes before it."""
    out, before = [p.letters(label, text[:SECRET])], hashlib.sha256(text[:SECRET].encode())
    for at in range(SECRET, len(text), SECRET):
        piece = text[at : at + SECRET]
        out.append(p.letters(f"{label}|{before.hexdigest()}", piece))
        before.update(piece.encode())
    return "".join(out)


def email(p: Permuter, text: str) -> str | None:
    name, _, host = text.partition("@")
    *own, site, top = host.split(".")
    if not name.strip(".") or not top.isalpha():
        return None
    return "@".join([chained(p, "name|" + host, name), ".".join([*(chained(p, "host", x) for x in [*own, site]), top])])


def emails(p: Permuter, text: str) -> Iterator[tuple[int, int, str, str]]:
    """Addresses, found from their @: the run before it and the host after it, each character seen once."""
    last = 0
    for m in re.finditer("@", text):
        start = m.start()
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        last = m.end()
        host = HOST.match(text, m.end())
        if host and start < m.start() and (new := email(p, text[start : host.end()])) is not None:
            yield start, host.end(), "email", new


def secret(p: Permuter, text: str) -> str | None:
    return chained(p, "secret", text) if any(map(str.isalnum, text)) else None


def secrets(p: Permuter, text: str) -> Iterator[tuple[int, int, str, str]]:
    """Named values, bearer tokens and keys that their prefixes tell. A text without any of the names is not searched."""
    lower = text.lower()
    for m in NAMED.finditer(text) if any(name in lower for name in NAMES) else ():
        kind = next(k for k in ("quoted", "set", "told", "prose") if m.group(k) is not None)
        value = m.group(kind) if kind == "quoted" else m.group(kind).rstrip(CLOSING)
        if kind == "prose" and PLAIN_WORD.fullmatch(value):
            continue
        if (new := secret(p, value)) is not None:
            yield m.start(kind), m.start(kind) + len(value), "secret", new
    for m in BEARER.finditer(text) if "Bearer" in text else ():
        value = m.group(1).rstrip(CLOSING)
        if any(c in DIGITS or c == "." for c in value) and (new := secret(p, value)) is not None:
            yield m.start(1), m.start(1) + len(value), "secret", new
    for m in ACCESS_KEY.finditer(text) if any(name in text for name in KEY_PREFIXES) else ():
        yield *m.span(2), "access_key", chained(p, "access_key", m.group(2))


def ipv6(p: Permuter, text: str) -> str | None:
    """Hexadecimal digits permuted in their places, each in the case of its own."""
    places = [i for i, c in enumerate(text) if c != ":"]
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if len(places) < 4:  # ``::1`` and the like name nobody
        return None
    value = p.number(f"ipv6|{''.join('x' if c != ':' else c for c in text)}", int("".join(text[i] for i in places), 16), 16 ** len(places))
    upper, out = any(c in "ABCDEF" for c in text), list(text)
    for i, c in zip(places, f"{value:0{len(places)}x}", strict=True):
        out[i] = c.upper() if upper else c
    return "".join(out)


NUMBERS: dict[str, Callable[[Permuter, str], str | None]] = {
    "ipv4": ipv4, "iso_date": iso_date, "date": date, "ssn": ssn, "card": card, "phone": phone,
}


def numbers(p: Permuter, text: str) -> Iterator[tuple[int, int, str, str]]:
    """The numbers of a text: at each start the first kind, and of it the longest prefix, that is valid."""
    at = 0
    while m := START.search(text, at):
        at = m.start() + 1
        for kind, pattern in NUMBER.items():
            end = len(text)
            while m := pattern.match(text, at - 1, end):
                end = m.end() - 1
                follows = AFTER_CARD if kind == "card" else AFTER
                if not follows.match(text, m.end()) and (new := NUMBERS[kind](p, m.group())) is not None:
                    yield *m.span(), kind, new
                    at = m.end()
                    break
            if m:
                break


def find(p: Permuter, text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, pseudonym)`` of the values of a text, in order and without overlaps."""
    found = []

    def take(pattern: re.Pattern, kind: str, fn: Callable, group: int = 0) -> None:
        for m in pattern.finditer(text):
            if (new := fn(p, m.group(group))) is not None:
                found.append((m.start(group), m.end(group), kind, new))

    if "@" in text:
        found += emails(p, text)
    found += secrets(p, text)
    if any(c in text for c in DIGITS):
        take(IBAN, "iban", iban)
        found += numbers(p, text)
    if "::" in text or text.count(":") > 6:
        take(IPV6, "ipv6", ipv6)
    out, last = [], 0
    for one in sorted(found, key=lambda x: (x[0], -x[1])):
        if one[0] >= last:
            out.append(one)
            last = one[1]
    return out


def pseudonymise(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """Replace the values found in every text by their pseudonyms.

    Returns one row per input row: ``id_col``, ``text_col`` (replaced), ``n_found``, ``found`` (kind,
    start and end in the old text, pseudonym) and the ``carry`` columns. Null stays null, an empty text empty; repeated
    rows give repeated results. Of overlapping values the one that starts first, then the longer one,
    counts. Other columns, also of clashing names, are left out. An empty table gives an empty result.
    """
    values = "array<struct<kind:string,start:long,end:long,pseudonym:string>>"
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))
        for table in B.batched(batches, BATCH_BYTES, "_text"):
            texts, found = [], []
            for text in table.column("_text").to_pylist():
                own = find(p, text) if text else []
                parts, last = [], 0
                for start, end, _, new in own:
                    parts += [text[last:start], new]
                    last = end
                texts.append("".join([*parts, text[last:]]) if own else text)
                found.append([{"kind": k, "start": s, "end": e, "pseudonym": new} for s, e, k, new in own])
            table = table.set_column(table.schema.get_field_index("_text"), "_text", pa.array(texts, pa.string()))
            yield from table.append_column("_found", pa.array(found, kind)).to_batches()

    out = given.mapInArrow(run, f"{kinds}, _found {values}")
    kept = [F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.size("_found").cast("long").alias("n_found"), F.col("_found").alias("found"), *kept)
