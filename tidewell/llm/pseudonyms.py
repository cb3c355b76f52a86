"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Found values are validated and then permuted within their own format by a Feistel network of ``ROUNDS`` rounds whose
round function is a keyed hash, so one value has one pseudonym in every document, different values have different ones, and
whoever holds the key can invert it. What does not stay valid is permuted again until it is (cycle walking). A value is one also
where it is written otherwise: e-mail addresses are permuted without regard to case, and a day is permuted alike in every order and padding.
So that a pseudonym is read in the same order again, days up to the 12th stay among those and later ones among theirs.

======== ============================================================ =====================================================
kind     found if                                                     pseudonym
======== ============================================================ =====================================================
email    local part, @, dotted domain                                 letters and digits of all but the last label permuted
secret   known key prefixes; values after password=, token =, api_key letters and digits after the prefix permuted
iban     country, check digits right modulo 97                        account part permuted, check digits recomputed
card     13 to 19 digits, right by the Luhn sum                       first digit kept, check digit recomputed
ssn      three, two, four digits with hyphens, in the issued ranges   the nine digits, in the issued ranges
date     a day of the calendar from 1900 to 2099, year first or last  another day of those, written alike
ip       four numbers up to 255 with dots                             another address
phone    + and country code, or area code in the usual forms          digits after the country code permuted
======== ============================================================ =====================================================

Separators, signs and letter case stay where they were. Numbers that fail their validation are left alone, as are texts
without any value. Null texts count as empty. Every row gives one row; repeated rows give equal rows; texts are searched whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import carried, column, documents, inputs, map_batches, typed

ROUNDS = 10
#: Stands in where no key is given; pass a secret one in production.
DEMO_KEY = b"tidewell demonstration key"
#: The session setting that ``session_key`` reads; Spark redacts it in its logs and pages.
KEY_SETTING = "spark.tidewell.pseudonym.secret"

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]))
  | (?P<secret>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36}(?![A-Za-z0-9])
      |(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?["']?)(?P<value>(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8,}(?![A-Za-z0-9]))))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<phone>(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?P<p>[.-])[0-9]{3}(?P=p)[0-9]{4})(?![\w-]))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<date>(?<![\w/.-])(?:(?:19|20)[0-9]{2}(?P<y>[-/.])[0-9]{1,2}(?P=y)[0-9]{1,2}|[0-9]{1,2}(?P<d>[-/.])[0-9]{1,2}(?P=d)(?:19|20)[0-9]{2})(?![\w/-]))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
  | (?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """,
    re.VERBOSE,
)
KINDS = ("email", "secret", "iban", "phone", "ssn", "date", "ip", "card")

#: Country codes of one and two digits; others have three. ITU zones.
_ONE, _TWO = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


class Permuter:
    """Keyed permutations of the numbers below a size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, number: int, half: int) -> int:
        digest = hashlib.blake2b(f"{kind}|{size}|{number}|{half}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big")

    def _once(self, kind: str, size: int, rows: int, columns: int, x: int, back: bool) -> int:
        a, b = divmod(x, columns)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._round(kind, size, r, a)) % columns
            else:
                a = (a + sign * self._round(kind, size, r, b)) % rows
        return a * columns + b

    def permute(self, kind: str, size: int, x: int, valid=None, back: bool = False) -> int:
        """The image of x below size among the numbers that ``valid`` accepts, which x must be one of."""
        columns = max(1, int(np.ceil(np.sqrt(float(size)))) if size < 1 << 50 else 1 << -(-size.bit_length() // 2))
        rows = -(-size // columns)
        y = self._once(kind, size, rows, columns, x, back)
        while y >= size or valid is not None and not valid(y):
            y = self._once(kind, size, rows, columns, y, back)
        return y


def luhn_sum(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _refill(shape: str, characters: str) -> str:
    """Puts new letters and digits where shape has some."""
    out = iter(characters)
    return "".join(next(out) if c.isalnum() else c for c in shape)


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting, or the demonstration key."""
    return spark.conf.get(KEY_SETTING, "").encode() or DEMO_KEY


class Pseudonymiser:
    def __init__(self, key: bytes = DEMO_KEY):
        self.permuter = Permuter(key)
        self.of = lru_cache(100_000)(self._of)

    def _mixed(self, kind: str, text: str, back: bool) -> str:
        """Permutes letters among letters of their case and digits among digits, all in one number."""
        sizes = [10 if c.isdigit() else 26 for c in text if c.isalnum()]
        plain = [c for c in text if c.isalnum()]
        shape = "".join("9" if c.isdigit() else "a" if c.islower() else "A" for c in plain)
        x, size = 0, 1
        for c, n in zip(plain, sizes, strict=True):
            x, size = x * n + (ord(c) - ord("0" if n == 10 else "a" if c.islower() else "A")), size * n
        if size == 1:
            return text
        y, out = self.permuter.permute(f"{kind}|{shape}", size, x, back=back), []
        for s, n in zip(reversed(shape), reversed(sizes), strict=True):
            y, d = divmod(y, n)
            out.append(chr(ord("0" if n == 10 else s) + d))
        return _refill(text, "".join(reversed(out)))

    def _digits(self, kind: str, digits: str, valid=None, back: bool = False) -> str:
        n = len(digits)
        check = None if valid is None else lambda y: valid(f"{y:0{n}d}")
        return f"{self.permuter.permute(f'{kind}|{n}', 10**n, int(digits), check, back):0{n}d}" if n else ""

    def _of(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value as written (or with ``back`` the value of a pseudonym), or None if it is not valid."""
        digits = "".join(c for c in value if c.isdigit())
        if kind == "email":
            name, _, domain = value.rpartition("@")
            labels, _, last = domain.rpartition(".")
            new = f"{self._mixed('name', name.lower(), back)}@{self._mixed('domain', labels.lower(), back)}.{last}"
            return "".join(n.upper() if c.isupper() else n for c, n in zip(value, new, strict=True))
        if kind == "secret":
            if re.fullmatch("[0-9a-f]*[a-f][0-9a-f]*", value):  # hexadecimal stays so
                return f"{self.permuter.permute(f'hex{len(value)}', 16 ** len(value), int(value, 16), lambda y: not f'{y:0{len(value)}x}'.isdigit(), back):0{len(value)}x}"
            return self._mixed("secret", value, back)
        if kind == "card":
            if not 13 <= len(digits) <= 19 or luhn_sum(digits) or len(set(digits)) == 1:
                return None
            new = digits[0] + self._digits("card" + digits[0], digits[1:-1], back=back)
            return _refill(value, new + str(-luhn_sum(new + "0") % 10))
        if kind == "iban":
            code = value.replace(" ", "")
            if not 15 <= len(code) <= 34 or _iban_rest(code) != 1:
                return None
            account = self._mixed("iban" + code[:2], code[4:], back)
            return _refill(value, f"{code[:2]}{98 - _iban_rest(code[:2] + '00' + account):02d}{account}")
        if kind == "ssn":
            def issued(d: str) -> bool:
                return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

            return _refill(value, self._digits("ssn", digits, issued, back)) if issued(digits) else None
        if kind == "ip":
            parts = [int(p) for p in value.split(".")]
            if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
                return None
            y = self.permuter.permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), back=back)
            return ".".join(map(str, y.to_bytes(4, "big")))
        if kind == "date":
            return self._date(value, back)
        if not 7 <= len(digits) <= 15:
            return None
        code = (next((c for c in (digits[0], digits[:2]) if c in _ONE or c in _TWO), digits[:3])) if value[0] == "+" else ""
        own = digits[len(code) :]

        def dialled(d: str) -> bool:
            return d[0] not in "01" and d[3] not in "01"

        if code == "1" or not code:
            if len(own) != 10 or not dialled(own):
                return None if not code else _refill(value, code + self._digits("phone" + code, own, back=back))
            return _refill(value, code + self._digits("phone1", own, dialled, back))
        return _refill(value, code + self._digits("phone" + code, own, back=back))

    def _date(self, value: str, back: bool) -> str | None:
        mark = next(c for c in value if not c.isdigit())
        parts = value.split(mark)
        year_first = len(parts[0]) == 4
        orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)] if mark != "/" else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            try:
                day = datetime.date(*(int(parts[k]) for k in order))
            except ValueError:
                continue
            size = (LAST_DAY - FIRST_DAY).days + 1

            def same_side(y: int, late=day.day > 12) -> bool:
                # whether a day can be a month decides which order a date is read in
                return ((FIRST_DAY + datetime.timedelta(y)).day > 12) == late

            y = self.permuter.permute("date", size, (day - FIRST_DAY).days, same_side, back)
            # days and months keep two places, or one where they had one and still can
            wide = all(len(parts[k]) == 2 for k in order[1:])
            new = FIRST_DAY + datetime.timedelta(y)
            out = ["", "", ""]
            for k, n in zip(order, (new.year, new.month, new.day), strict=True):
                out[k] = str(n) if len(parts[k]) == 4 or not wide else f"{n:02d}"
            return mark.join(out)
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and (kind, start, end, pseudonym) of each, by places in the text given."""
        out, found, at = [], [], 0
        for m in PATTERN.finditer(text):
            kind = next(k for k in KINDS if m[k])
            value, (start, end) = (m["value"], m.span("value")) if m["value"] else (m[0], m.span())
            kept = 4 if kind == "secret" and not m["value"] else 0  # a known prefix stays
            new = self.of(kind, value[kept:])
            if new is None and kind == "phone":
                kind, new = "card", self.of("card", value)
            if new is not None:
                out += [text[at : start + kept], new]
                found.append((kind, start, end, value[:kept] + new))
                at = end
        return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes = DEMO_KEY, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, found array<struct<kind, start, end, pseudonym>> of every row, and columns to carry."""

    def make():
        own = Pseudonymiser(key)

        def run(table: pa.Table) -> pa.Table:
            texts = column(table, "text")
            # only texts with a digit or an @ can hold a value
            some = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            results = [own.replace(t) if s else (t, []) for t, s in zip(texts.to_pylist(), some, strict=True)]
            spans = pa.array([[dict(zip(("kind", "start", "end", "pseudonym"), f, strict=True)) for f in found] for _, found in results], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())])))
            return pa.table(carried(table, names) | {"text": pa.array([t for t, _ in results], pa.string()), "n_found": pa.array([len(f) for _, f in results], pa.int32()), "found": spans})

        return run

    names = ["doc_id", *carry]
    docs = inputs(docs, id_col, text_col, *carry)
    return map_batches(docs, make, f"{typed(docs, names)}text string, n_found int, found array<struct<kind:string,start:int,end:int,pseudonym:string>>")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced, by the session's key."""
    return pseudonymise(documents(spark, sf_dir), session_key(spark))
