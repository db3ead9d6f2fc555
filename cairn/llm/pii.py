"""Format-preserving pseudonyms for personal data.

A validated value is read as a number of its format's domain, moved by a keyed Feistel permutation of that domain
(cycle-walked to its size) and written back in the same format, so equal values keep equal pseudonyms everywhere and
different values never meet. The permutation has no fixed point: no value stands for itself.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import frugal, slices

ROUNDS = 8
#: Length of a bank account number (IBAN) by country. Fixed values of the published registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Country calling codes of one and of two digits; all others have three. Fixed values of the published numbering plan.
SHORT_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
MONTHS = "January February March April May June July August September October November December".split()
MONTH_NUMBER = {m[:3].lower(): n + 1 for n, m in enumerate(MONTHS)}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0 .. size - 1 without fixed points (size 1 has none to offer: its value stays)."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(f"{tweak}\x1f{size}".encode(), key=key, digest_size=32).digest()
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.seed, digest_size=16).digest(), "big") % (size - 1) if size > 1 else 0

    def _round(self, n: int, x: int) -> int:
        need = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(need, "big"), key=self.seed, digest_size=need, salt=bytes([n])).digest(), "big") & self.mask

    def _walk(self, x: int, rounds: range, forward: bool) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for n in rounds:
                if forward:
                    left, right = right, left ^ self._round(n, right)
                else:
                    left, right = right ^ self._round(n, left), left
            x = left << self.half | right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        y = self._walk(x, range(ROUNDS), True)
        return self._walk((y + self.step) % self.size, range(ROUNDS - 1, -1, -1), False) if self.size > 1 else x

    def inverse(self, x: int) -> int:
        y = self._walk(x, range(ROUNDS), True)
        return self._walk((y - self.step) % self.size, range(ROUNDS - 1, -1, -1), False) if self.size > 1 else x


@functools.lru_cache(4096)
def permutation(key: bytes, tweak: str, size: int) -> Permutation:
    return Permutation(key, tweak, size)


def luhn(digits: str) -> int:
    """The sum modulo 10 that is 0 for a valid number."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _number(key: bytes, digits: str, tweak: str) -> str:
    """Digits of equal count; the first digit keeps being zero or non-zero."""
    n = len(digits)
    if digits[0] == "0" or n == 1:
        return (digits[0] if n > 1 else "") + f"{permutation(key, tweak, 10 ** max(1, n - 1))(int(digits[1:] or digits)):0{max(1, n - 1)}d}"
    low = 10 ** (n - 1)
    return str(low + permutation(key, tweak, 9 * low)(int(digits) - low))


def card(key: bytes, text: str) -> str | None:
    """Payment card number of 13 to 19 digits with a valid check digit, which the pseudonym has too."""
    digits = "".join(c for c in text if c.isdigit())
    return digit_run(key, text) if luhn(digits) == 0 else None


def digit_run(key: bytes, text: str) -> str | None:
    """Any 13 to 19 digits. The check sum stays what it was: valid stays valid, and others never become so."""
    digits = "".join(c for c in text if c.isdigit())
    if not 13 <= len(digits) <= 19:
        return None
    state = luhn(digits)
    body = _number(key, digits[:-1], "card")
    last = next(str(d) for d in range(10) if luhn(body + str(d)) == state)
    return _refill(text, body + last)


def phone(key: bytes, text: str) -> str | None:
    """Seven to fifteen digits; a leading country code (after +) stays, and the (0) that may follow it."""
    country = re.match(rf"\+(?:{'|'.join(SHORT_CODES)}|\d{{1,3}})(?:[ .\-]?\(0\))?", text)
    skip = country.end() if country else 0
    digits = "".join(c for c in text[skip:] if c.isdigit())
    if not 7 <= len(digits) <= 15:
        return None
    return text[:skip] + _refill(text[skip:], f"{permutation(key, 'phone', 10 ** len(digits))(int(digits)):0{len(digits)}d}")


def ssn(key: bytes, text: str) -> str | None:
    """US social security numbers: area 001-665 or 667-899, group and serial not zero."""
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, s = divmod(permutation(key, "ssn", 898 * 99 * 9999)(x), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}{text[3]}{g + 1:02d}{text[6]}{s + 1:04d}"


def ipv4(key: bytes, text: str) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    x = permutation(key, "ipv4", 2**32)(int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def ipv6(key: bytes, text: str) -> str | None:
    """Addresses with a digit and three groups at least (fewer are often code); a full one stays full, another short."""
    groups = [g for g in text.split(":") if g]
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if len(groups) < 3 or not any(c.isdigit() for c in text):
        return None
    new = ipaddress.IPv6Address(permutation(key, "ipv6", 2**128)(int(address)))
    written = new.exploded if text.lower() == address.exploded else str(new)
    return written.upper() if any(c.isupper() for c in text) else written


def iban(key: bytes, text: str) -> str | None:
    """Country and length stay, check digits are recomputed; letters stay letters (of their case) and digits digits."""
    plain = re.sub(r"[\s\-]", "", text).upper()
    if IBAN_LENGTH.get(plain[:2]) != len(plain) or _mod97(plain) != 1:
        return None
    account = _by_class(key, plain[4:], "iban")
    check = 98 - _mod97(plain[:2] + "00" + account)
    it = iter(f"{plain[:2]}{check:02d}{account}")
    return "".join(c if c in " -" else next(it).lower() if c.islower() else next(it) for c in text)


def _mod97(plain: str) -> int:
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _by_class(key: bytes, text: str, tweak: str, hexadecimal: bool = False) -> str:
    """Each ASCII digit, lower and upper letter moves within its class; the text's pattern of classes is the format."""
    radix = {"d": 10, "l": 26, "u": 26, "x": 16, "X": 16}
    kinds = [("x" if c.islower() or c.isdigit() else "X") if hexadecimal else "d" if c.isascii() and c.isdigit() else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "" for c in text]
    if hexadecimal and any(c.isupper() for c in text):
        kinds = ["X"] * len(text)
    x, size = 0, 1
    for c, k in zip(text, kinds, strict=True):
        if k:
            x = x * radix[k] + (int(c, 16) if k in "xX" else ord(c) - ord({"d": "0", "l": "a", "u": "A"}[k]))
            size *= radix[k]
    if size < 2:
        return text
    x = permutation(key, tweak + "".join(k or "-" for k in kinds), size)(x)
    out = []
    for c, k in zip(reversed(text), reversed(kinds), strict=True):
        if not k:
            out.append(c)
            continue
        x, d = divmod(x, radix[k])
        out.append(f"{d:x}" if k == "x" else f"{d:X}" if k == "X" else chr(d + ord({"d": "0", "l": "a", "u": "A"}[k])))
    return "".join(reversed(out))


#: What an e-mail local part may hold beside letters and digits.
SYMBOLS = "._%+-"


def email(key: bytes, text: str) -> str | None:
    """The local part moves within its pattern of character classes, one of symbols only among those; the domain stays."""
    local, at, domain = text.rpartition("@")
    tweak = "email@" + domain.lower()
    if any(c not in SYMBOLS for c in local):
        return _by_class(key, local, tweak) + at + domain
    x, size = 0, len(SYMBOLS) ** len(local)
    for c in local:
        x = x * len(SYMBOLS) + SYMBOLS.index(c)
    x, out = permutation(key, tweak + "symbols", size)(x), ""
    for _ in local:
        x, d = divmod(x, len(SYMBOLS))
        out = SYMBOLS[d] + out
    return out + at + domain


#: How tokens of known issuers begin, as patterns, and what follows. Published formats, fixed values.
ISSUED = ((r"sk-", r"[A-Za-z0-9]{20,64}"), (r"gh[pousr]_", r"[A-Za-z0-9]{30,64}"), (r"AKIA", r"[A-Z0-9]{16}"), (r"AIza", r"[A-Za-z0-9_\-]{35}"), (r"glpat-", r"[A-Za-z0-9_\-]{20}"), (r"xox[abprs]-", r"[A-Za-z0-9\-]{10,120}"))
_PREFIX = re.compile("|".join(p for p, _ in ISSUED))


def secret(key: bytes, text: str) -> str | None:
    """Hexadecimal keys, and tokens behind their issuer's prefix, which stays."""
    known = _PREFIX.match(text)
    head = known[0] if known else ""
    return head + _by_class(key, text[len(head) :], "secret" + head, not known)


def _is_late(day: int) -> bool:
    """Days of the month above 12: in figures, those that cannot be taken for a month."""
    return datetime.date.fromordinal(day).day > 12


@functools.cache
def _days(late: bool) -> list[int]:
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if _is_late(d) == late]


def _moved_day(key: bytes, day: int) -> datetime.date | None:
    """Days up to the 12th and later ones move among themselves, in every format alike: a date that could be read in
    two orders stays one, and what can be read only day first never meets what is read month first."""
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    late = _is_late(day)
    days = _days(late)
    return datetime.date.fromordinal(days[permutation(key, f"date{late:d}", len(days))(bisect.bisect_left(days, day))])


def _named_date(key: bytes, text: str) -> str | None:
    """A date with a month name: order, separators, case, short or long name and ordinal endings stay as they are."""
    parts = re.findall(r"\d+|[A-Za-z]+|[^\dA-Za-z]+", text)
    month_at = next(n for n, p in enumerate(parts) if p[:3].lower() in MONTH_NUMBER)
    year_at = next(n for n, p in enumerate(parts) if p.isdigit() and len(p) == 4)
    day_at = next(n for n, p in enumerate(parts) if p.isdigit() and n != year_at)
    try:
        day = datetime.date(int(parts[year_at]), MONTH_NUMBER[parts[month_at][:3].lower()], int(parts[day_at])).toordinal()
    except ValueError:
        return None
    new = _moved_day(key, day)
    if new is None:
        return None
    like = lambda old, word: word.upper() if old.isupper() else word.lower() if old.islower() else word
    old, name = parts[month_at], MONTHS[new.month - 1]
    parts[month_at] = like(old, name if old.capitalize() in MONTHS else name[:3])
    parts[year_at] = str(new.year)
    parts[day_at] = f"{new.day:02d}" if len(parts[day_at]) == 2 else str(new.day)
    if parts[day_at + 1 : day_at + 2] and parts[day_at + 1].lower() in ("st", "nd", "rd", "th"):
        parts[day_at + 1] = like(parts[day_at + 1], "th" if new.day in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th"))
    return "".join(parts)


def date(key: bytes, text: str) -> str | None:
    """Calendar dates of 1900 to 2099 as YYYY-MM-DD, DD.MM.YYYY, MM/DD/YYYY (or DD/MM where only that is valid), or
    with an English month name."""
    if any(c.isalpha() for c in text):
        return _named_date(key, text)
    for pattern, order in (
        (r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", "ymd"),
        (r"(\d{1,2})(\.)(\d{1,2})\2(\d{4})", "dmy"),
        (r"(\d{1,2})([/-])(\d{1,2})\2(\d{4})", "mdy"),
        (r"(\d{1,2})([/-])(\d{1,2})\2(\d{4})", "dmy"),
    ):
        m = re.fullmatch(pattern, text)
        if not m:
            continue
        got = dict(zip(order, (m[1], m[3], m[4]), strict=True))
        try:
            day = datetime.date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal()
        except ValueError:
            continue
        new = _moved_day(key, day)
        if new is None:
            return None
        padded = all(len(got[k]) == 2 for k in "md") and (got["m"][0] == "0" or got["d"][0] == "0" or order == "ymd")
        value = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if padded or len(got["m"]) == 2 else str(new.month), "d": f"{new.day:02d}" if padded or len(got["d"]) == 2 else str(new.day)}
        return m[2].join(value[k] for k in order)
    return None


def _iban_pattern() -> str:
    """Each country's length, in groups of four with or without blanks or hyphens: never more nor less of the text."""
    by_length: dict[int, list[str]] = {}
    for country, size in IBAN_LENGTH.items():
        by_length.setdefault(size - 4, []).append(country)
    forms = [f"(?i:{'|'.join(cs)})\\d{{2}}(?:[ \\-]?[A-Za-z0-9]{{4}}){{{n // 4}}}" + (f"[ \\-]?[A-Za-z0-9]{{{n % 4}}}" if n % 4 else "") for n, cs in by_length.items()]
    return rf"(?<![A-Za-z0-9])(?=[A-Za-z]{{2}}\d{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


_MONTH = r"(?i:" + "|".join([*MONTHS, "Sept", *(m[:3] for m in MONTHS)]) + r")\b\.?"
_DAY = r"\d{1,2}(?i:st|nd|rd|th)?"
_NAMED = rf"{_DAY}(?: of)?[ \-]{_MONTH},?[ \-]\d{{4}}|{_MONTH}[ \-]{_DAY},?[ \-]\d{{4}}|\d{{4}}[ \-]{_MONTH}[ \-]\d{{1,2}}"
#: A leading + and country code, then up to this many groups; fewer are tried where more make no number.
_PLUS = r"(?<![\w+])\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{2,4}}(?:[ .\-]?\d{{2,4}}){{1,{}}}(?!\w)"

#: (kind, pattern, pseudonym), tried in this order at each place.
KINDS: tuple[tuple[str, str, Callable[[bytes, str], str | None]], ...] = (
    ("email", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}", email),
    ("secret", r"(?:(?<![^\s\"'=:(\[,;])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})|(?<![A-Za-z0-9])(?:" + "|".join(p + q for p, q in ISSUED) + r"))(?![A-Za-z0-9])", secret),
    ("iban", _iban_pattern(), iban),
    ("phone", _PLUS.format(4) + r"|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w\-])", phone),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", ssn),
    ("card", r"(?<![\w.\-])\d{13,19}(?![\w\-])|(?<![\w.\-])\d{4}(?:[ \-]\d{4}){3}(?![\w\-])|(?<![\w.\-])3\d{3}[ \-]\d{6}[ \-]\d{5}(?![\w\-])", card),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", ipv4),
    ("ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![\w:]|\.\w)", ipv6),
    ("date", r"(?<![\w.\-/])(?:\d{4}(?P<sep>[-/.])\d{1,2}(?P=sep)\d{1,2}(?=[Tt]\d{2}|(?![\w\-/]))|(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|" + _NAMED + r")(?![\w\-/]))", date),
)
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS), re.A)
MAKERS = {k: f for k, _, f in KINDS} | {"digit_run": digit_run}
TRIES = [(k, re.compile(p, re.A)) for kind, pattern, _ in KINDS for k, p in [(kind, pattern), *((kind, _PLUS.format(n)) for n in (3, 2, 1) if kind == "phone")]]


def pseudonymise(text: str, key: bytes, unchecked: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its personal values exchanged, and (kind, start, length) of each in the new text.

    unchecked: digit runs of a card's length without a valid check digit are exchanged too."""
    found: list[tuple[str, int, int]] = []
    out: list[str] = []
    at = done = shift = 0
    while m := FINDER.search(text, at):
        start = m.start()
        hit = _value_at(text, start, key, unchecked)
        if hit is None:
            at = start + 1
            continue
        kind, at, new = hit
        out += (text[done:start], new)
        found.append((kind, start + shift, len(new)))
        shift += len(new) - (at - start)
        done = at
    return ("".join(out) + text[done:] if found else text), found


def _value_at(text: str, start: int, key: bytes, unchecked: bool) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the first kind whose value at this place is valid."""
    for kind, pattern in TRIES:
        m = pattern.match(text, start)
        new = _cached(key, "digit_run" if unchecked and kind == "card" else kind, m[0]) if m else None
        if new is not None:
            return kind, m.end(), new
    return None


@functools.lru_cache(1 << 16)
def _cached(key: bytes, kind: str, value: str) -> str | None:
    return MAKERS[kind](key, value)


#: What every value holds a piece of; texts and lines without it are passed over.
SIGN = re.compile("|".join([r"[0-9@]|[a-f]{32}|[A-F]{32}", *(p for p, _ in ISSUED)]))


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text", unchecked: bool = False) -> DataFrame:
    """All columns of docs with the text's personal values exchanged, plus `pii`: array of (kind, start, length).

    Null texts stay null and empty ones empty, with an empty array; whole texts are read, however long, line by line where a
    line can hold a value; repeated rows give equal results; an empty table gives no rows; an existing column `pii` is
    replaced and all others stay. Whoever has the key can undo the pseudonyms. Numbers must pass their format's check
    (cards: the check digit); `unchecked` exchanges digit runs of a card's length without it too.
    """
    secret_key = key.encode()
    frame = docs.drop("pii")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    fields = T.StructType([*frame.schema.fields, T.StructField("pii", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
    at = frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 22):
                texts, spans = [], []
                for t in part.column(text_col).to_pylist():
                    if t is None or not SIGN.search(t):
                        texts.append(t)
                        spans.append([])
                        continue
                    lines, found, start = t.split("\n"), [], 0
                    for n, line in enumerate(lines):
                        if SIGN.search(line):
                            lines[n], more = pseudonymise(line, secret_key, unchecked)
                            found += [{"kind": k, "start": start + s, "length": size} for k, s, size in more]
                        start += len(lines[n]) + 1
                    texts.append("\n".join(lines))
                    spans.append(found)
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*part.schema.names, "pii"])

    return frame.mapInArrow(frugal(run), fields)
