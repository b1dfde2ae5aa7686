"""Format-preserving pseudonyms for personal data.

Finders give candidates; each is validated (Luhn and mod-97 check digits, calendar dates, octet ranges,
number plans) and turned into a number below the size of its format. A keyed Feistel network permutes that
number; steps that fall outside the format are walked on until they are inside again, so the result is a
permutation of the format itself. Where a finder's longest candidate is not valid, its shorter ends at token edges
and the finders after it are tried, so a value is found beside other tokens. Check digits are made anew, separators and paddings stay. Equal values
give equal pseudonyms in all documents, whatever their separators, case (of e-mail addresses) or way of writing a
date, and the key gives the values back.

Formats: e-mail addresses (letters and digits of all labels but the last), telephone numbers (the country code
stays, by the table of codes, and so do a trunk 0 and a leading digit other than 0; a number with a country code and
the same one without are linked in the North American plan alone), payment cards (the first digit stays), IBANs (the
country stays), US social security numbers, IPv4 addresses, dates from 1900 to 2099 in figures, before a time of
day, or with the month in words (four languages), cloud access keys, and long hexadecimal secrets. A pseudonym may
equal its value by chance, once in the size of its format.

Null texts stay null, empty ones empty; whole texts are searched, and rows with equal ids are rows of their own.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wayfare.llm.words import slices

ROUNDS = 10
KINDS = ("email", "iban", "phone", "card", "ssn", "ip", "date", "access_key", "secret")

# Telephone country codes of one and two digits (ITU-T E.164); all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# Names of months. German ones are read after a day with a full stop, the others without.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en_short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
}


def _names(*languages: str) -> str:
    return "(?i:" + "|".join(sorted({m for x in languages for m in MONTHS[x]}, key=lambda m: (-len(m), m))) + ")"


# Quantifiers are possessive and matches begin at an edge, so time is linear in the text.
FINDERS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}(?P<a>[-/.])[0-9]{1,2}(?P=a)[0-9]{1,2}|[0-9]{1,2}(?P<b>[-/.])[0-9]{1,2}(?P=b)[0-9]{4})(?!(?!T[0-9]{2}:)[\w/-]|\.[0-9])",
    "date_in_words": rf"(?<![\w/.-])(?:[0-9]{{1,2}}(?:\. {_names('de')}|(?:st|nd|rd|th)?(?: of)? {_names('en', 'en_short', 'fr')}|(?: de)? {_names('es')}(?: de)?),? [0-9]{{4}}|{_names('en', 'en_short')} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}})(?![\w/-]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|-[0-9])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<c>[ .-])[0-9]{3}(?P=c)[0-9]{4})(?![\w]|-[0-9])",
    "national_phone": r"(?<![\w.-])0[1-9][0-9]{0,3}(?:[ .-][0-9]{2,8}){1,4}(?![\w]|[.-][0-9])",
}
#: Finders that are counted as another kind.
COUNTED = {"date_in_words": "date", "national_phone": "phone"}
PATTERN = re.compile("|".join(f"(?P<{kind}>{finder})" for kind, finder in FINDERS.items()))
#: Each finder alone, and what may not come after its match.
ONE = {kind: re.compile(finder) for kind, finder in FINDERS.items()}
AFTER = {kind: re.compile(FINDERS[kind][FINDERS[kind].rindex("(?!"):]) for kind in ("iban", "card", "phone", "national_phone")}
RUN = re.compile(r"[A-Za-z0-9]*")
DOMAIN_END = re.compile(r"\.[A-Za-z]{2,}+(?![A-Za-z0-9])")
_EPOCH, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


class Feistel:
    """A keyed permutation of 0..size-1 for any size; ``tweak`` gives each format its own."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, value: int, tweak: bytes, i: int, bits: int) -> int:
        data = tweak + bytes((i,)) + value.to_bytes((bits + 7) // 8, "big")
        out, n = b"", (bits + 7) // 8
        while len(out) < n:
            out += hashlib.blake2b(data + bytes((len(out) // 64,)), key=self.key).digest()
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def _walk(self, value: int, size: int, tweak: bytes, order: range) -> int:
        bits = max(2, (size - 1).bit_length() + ((size - 1).bit_length() & 1)) // 2
        mask = (1 << bits) - 1
        tweak = tweak + b"\0" + size.to_bytes((size.bit_length() + 7) // 8, "big")
        while True:
            left, right = value >> bits, value & mask
            if order.step > 0:
                for i in order:
                    left, right = right, left ^ self._round(right, tweak, i, bits)
            else:
                for i in order:
                    left, right = right ^ self._round(left, tweak, i, bits), left
            value = left << bits | right
            if value < size:
                return value

    def encrypt(self, value: int, size: int, tweak: bytes = b"") -> int:
        return self._walk(value, size, tweak, range(ROUNDS))

    def decrypt(self, value: int, size: int, tweak: bytes = b"") -> int:
        return self._walk(value, size, tweak, range(ROUNDS - 1, -1, -1))


Permute = Callable[[int, int, bytes], int]
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(text: str, permute: Permute, tweak: bytes) -> str:
    """Permute letters among letters of their case and digits among digits; all else stays."""
    kinds = [next((c for c in _CLASSES if x in c), None) for x in text]
    shape = bytes(0 if k is None else _CLASSES.index(k) + 1 for k in kinds)
    value, size = 0, 1
    for x, k in zip(text, kinds, strict=True):
        if k:
            value, size = value * len(k) + k.index(x), size * len(k)
    if size == 1:
        return text
    value, out = permute(value, size, tweak + shape), []
    for x, k in zip(reversed(text), reversed(kinds), strict=True):
        if k:
            value, digit = divmod(value, len(k))
            x = k[digit]
        out.append(x)
    return "".join(reversed(out))


def _digits(value: str) -> str:
    return "".join(x for x in value if x.isdigit())


def _refill(shape: str, digits: str) -> str:
    source = iter(digits)
    return "".join(next(source) if x.isdigit() else x for x in shape)


def luhn(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    return -sum(sum(divmod(2 * int(x), 10)) if i % 2 == 0 else int(x) for i, x in enumerate(reversed(digits))) % 10


def _mod97(country: str, bban: str) -> int:
    return int("".join(str(int(x, 36)) for x in bban + country + "00")) % 97


def _email(value: str, permute: Permute) -> str | None:
    head, dot, last = value.rpartition(".")
    if not last.isalpha() or len(last) < 2:
        return None
    fresh = _by_class(head.lower(), permute, b"email")
    return "".join(x.upper() if y.isupper() else x for x, y in zip(fresh, head, strict=True)) + dot + last


def _card(value: str, permute: Permute) -> str | None:
    digits = _digits(value)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = digits[0] + str(permute(int(digits[1:-1]), 10 ** (len(digits) - 2), b"card" + digits[:1].encode())).zfill(len(digits) - 2)
    return _refill(value, body + str(luhn(body)))


def _iban(value: str, permute: Permute) -> str | None:
    flat = value.replace(" ", "")
    country, check, bban = flat[:2], flat[2:4], flat[4:]
    if not 11 <= len(bban) <= 30 or 98 - _mod97(country, bban) != int(check):
        return None
    bban = _by_class(bban, permute, b"iban" + country.encode())
    fresh = iter(f"{country}{98 - _mod97(country, bban):02d}{bban}")
    return "".join(x if x == " " else next(fresh) for x in value)


def _ssn(value: str, permute: Permute) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    at = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(value: str, permute: Permute) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255 or not 1 <= octets[0] <= 223 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    at = permute(int.from_bytes(bytes((octets[0] - 1, *octets[1:])), "big"), 223 << 24, b"ip")
    return ".".join(map(str, (1 + (at >> 24), at >> 16 & 255, at >> 8 & 255, at & 255)))


def _date(value: str, permute: Permute) -> str | None:
    sep = next(x for x in value if not x.isdigit())
    parts = value.split(sep)
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        y, m, d = (int(parts[order.index(x)]) for x in "ymd")
        try:
            day = (datetime.date(y, m, d) - _EPOCH).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        fresh = _day(permute, day)
        short = min(len(parts[order.index(x)]) for x in "md") == 1
        made = {"y": f"{fresh.year:04d}", "m": str(fresh.month) if short else f"{fresh.month:02d}", "d": str(fresh.day) if short else f"{fresh.day:02d}"}
        return sep.join(made[x] for x in order)
    return None


def _day(permute: Permute, day: int) -> datetime.date:
    return _EPOCH + datetime.timedelta(permute(day, _DAYS, b"date"))


def _date_in_words(value: str, permute: Permute) -> str | None:
    (day, year), word = re.findall("[0-9]+", value), re.search(r"[^\W\d_]{3,}", re.sub("[0-9](?:st|nd|rd|th)", "", value))[0]
    languages = ("de",) if f"{day}." in value else ("en", "en_short", "fr", "es")
    language = next((x for x in languages if word.lower() in map(str.lower, MONTHS[x])), None)
    if language is None:  # a letter that only equals one of the name's when case is ignored
        return None
    month = [m.lower() for m in MONTHS[language]].index(word.lower())
    try:
        at = (datetime.date(int(year), month + 1, int(day)) - _EPOCH).days
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    fresh = _day(permute, at)
    name = MONTHS[language][fresh.month - 1]
    name = name.lower() if word.islower() else name.upper() if word.isupper() else name.capitalize()
    made = {day: f"{fresh.day:02d}" if day[0] == "0" else str(fresh.day), word: name, year: f"{fresh.year:04d}"}
    suffix = {1: "st", 2: "nd", 3: "rd"}.get(fresh.day % 10 if fresh.day // 10 != 1 else 0, "th")
    return re.sub("(?<=[0-9])(?:st|nd|rd|th)", suffix, re.sub("|".join(map(re.escape, sorted(made, key=len, reverse=True))), lambda m: made[m[0]], value))


def _phone(value: str, permute: Permute) -> str | None:
    trunk = value.find("(0)")  # said for callers at home, no part of the number
    shape = value.replace("(0)", "(*)", 1) if trunk >= 0 else value
    digits = _digits(shape)
    if not 7 <= len(digits) <= 15:
        return None
    code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3]) if value[0] == "+" else ""
    rest = digits[len(code) :]
    if len(rest) < 4 or code[:1] == "0":
        return None
    plan = len(rest) == 10 and code in ("", "1") and rest[0] in "23456789" and rest[3] in "23456789"
    if plan:  # the North American plan: area and exchange begin with 2 to 9
        at = ((int(rest[0]) - 2) * 100 + int(rest[1:3])) * 8_000_000 + (int(rest[3]) - 2) * 1_000_000 + int(rest[4:])
        at = permute(at, 800 * 8_000_000, b"phone")
        area, number = divmod(at, 8_000_000)
        rest = f"{area + 200}{number + 2_000_000}"
    else:
        rest = _number(rest, permute, b"phone" + code.encode())
    return _refill(shape, code + rest).replace("(*)", "(0)", 1)


def _number(digits: str, permute: Permute, tweak: bytes) -> str:
    """Digits for digits; those before the first that is not 0 stay, and that one does not become 0."""
    head = digits[: len(digits) - len(digits.lstrip("0"))]
    least = 10 ** (len(digits) - len(head) - 1) if len(head) < len(digits) else 0
    return head + str(least + permute(int(digits) - least, 9 * least, tweak + b"+%d" % len(head))) if least else digits


def _national_phone(value: str, permute: Permute) -> str | None:
    digits = _digits(value)
    return _refill(value, _number(digits, permute, b"phone0")) if 9 <= len(digits) <= 12 else None


def _access_key(value: str, permute: Permute) -> str | None:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    at = 0
    for x in value[4:]:
        at = at * 36 + letters.index(x)
    at, out = permute(at, 36**16, b"key"), []
    for _ in range(16):
        at, x = divmod(at, 36)
        out.append(letters[x])
    return value[:4] + "".join(reversed(out))


def _secret(value: str, permute: Permute) -> str | None:
    return f"{permute(int(value, 16), 16 ** len(value), b'secret'):0{len(value)}x}"


MAKERS = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date, "date_in_words": _date_in_words, "national_phone": _national_phone, "access_key": _access_key, "secret": _secret}


def _shorter(kind: str, value: str, text: str, start: int) -> Iterator[int]:
    """Ends of the shorter candidates of a finder's match ``value`` at ``start``, the longest first."""
    if kind == "email":
        ends = [m.end() for m in DOMAIN_END.finditer(value, value.index("@"))]
        if ends and ends[-1] < len(value):
            yield start + ends[-1]
    elif kind in AFTER:  # matches of bounded length; the others have one length or one edge
        for end in range(start + len(value) - 1, start, -1):
            if text[end] in " .-" and text[end - 1].isalnum() and AFTER[kind].match(text, end) and ONE[kind].fullmatch(text, start, end):
                yield end


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        network = Feistel(key)
        self.permute: Permute = network.decrypt if back else network.encrypt
        self.memo: dict[tuple[str, str], str | None] = {}

    def one(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, or null if it is not valid."""
        at = kind, value
        if at not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[at] = MAKERS[kind](value, self.permute)
        return self.memo[at]

    def at(self, text: str, match: re.Match) -> tuple[str, int, str] | None:
        """(kind, end, pseudonym) of the first valid candidate where ``match`` starts: its finder's and those after it, each longest first."""
        start, kinds = match.start(), list(FINDERS)
        for kind in kinds[kinds.index(match.lastgroup) :]:
            if found := ONE[kind].match(text, start):
                for end in (found.end(), *_shorter(kind, found[0], text, start)):
                    fresh = self.one(kind, text[start:end])
                    if fresh is not None:
                        return kind, end, fresh
        return None

    def text(self, text: str, counts: dict[str, int]) -> str:
        out, at, begin = [], 0, 0
        while match := PATTERN.search(text, begin):
            found = self.at(text, match)
            if found is None:
                # No finder has a valid value here; the next may begin after the first run.
                begin = match.start() + max(1, len(RUN.match(text, match.start())[0]))
                continue
            kind, begin, fresh = found
            kind = COUNTED.get(kind, kind)
            counts[kind] = counts.get(kind, 0) + 1
            out += (text[at : match.start()], fresh)
            at = begin
        out.append(text[at:])
        return "".join(out)


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key)
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.string())
            maybe = pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|AKIA|ASIA"), False).to_pylist()
            fresh, counts = texts.to_pylist(), [{} for _ in range(len(texts))]
            for i, look in enumerate(maybe):
                if look:
                    fresh[i] = tool.text(fresh[i], counts[i])
            columns = [pa.array([c.get(kind, 0) for c in counts], pa.int32()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(fresh, pa.string()), *columns, pa.array([sum(c.values()) for c in counts], pa.int32())],
                names=["doc_id", "text", *(f"n_{kind}" for kind in KINDS), "n_replaced"],
            )

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, a count for each kind, n_replaced) of each row of ``docs`` (doc_id, text). One pass, no shuffle."""
    schema = "doc_id long, text string, " + ", ".join(f"n_{kind} int" for kind in KINDS) + ", n_replaced int"
    return docs.select("doc_id", "text").mapInArrow(_rewrite(key), schema)


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with their texts pseudonymised and, if there, ``n_chars`` counted anew; other columns as they are."""
    schema, rewrite = docs.schema, _rewrite(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], names=["doc_id", "text"])
            text = pa.concat_arrays([x.column("text") for x in rewrite(iter((rows,)))])
            columns = {name: batch.column(name) for name in batch.schema.names} | {"text": text}
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(text).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([c.cast(batch.schema.field(n).type) for n, c in columns.items()], names=list(columns))

    return docs.mapInArrow(run, schema)
