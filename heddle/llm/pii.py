"""Format-preserving pseudonyms: keyed permutations of validated numbers, dates and addresses."""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import small_batches

KINDS = ("email", "iban", "date", "phone", "ssn", "ip", "card", "account")
#: Rounds of the Feistel networks, and pseudonyms that a worker keeps.
ROUNDS, CACHED_VALUES = 8, 200_000
#: Dates of these years are permuted among themselves, so that they stay plausible; all others of the
#: calendar, from year 1 to 9999, among themselves.
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Characters of a mail address's local part that are permuted as one number; longer ones in blocks.
EMAIL_BLOCK = 64

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
#: Stretches of digits and the signs that stand in numbers, in which numbers are sought.
STRETCH = re.compile(r"[0-9+(][0-9 ().:/+-]{5,}")
NUMBER = re.compile(
    r"(?P<date>(?<![0-9.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)


# Lengths of the account numbers of countries.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in """15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV
22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR
27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU""".split()) for c in cs.split(",")}


def iban_ends(m: re.Match, sized: bool) -> list[int]:
    """Where the number in a match of IBAN may end, the longest first: what stands after a space may
    be the next words'.  If ``sized``, where it has its country's length; else for a known country
    at the end of the match alone."""
    ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
    n = IBAN_LENGTHS.get(m[0][:2])
    if sized:
        return [e for e in ends if len(m.string[m.start() : e].replace(" ", "")) == n]
    return ends[:1] if n else ends


class Permutation:
    """Keyed permutation of 0 .. n-1 without fixed points: equal values stay equal, others differ,
    and no value stands for itself.

    A balanced Feistel network of HMAC-SHA-256 rounds permutes the least even number of bits that
    holds n; values beyond n walk on along their cycle.  The result is the network's inverse of its
    value's successor, which is never the value itself.
    """

    def __init__(self, key: bytes, name: str, n: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [hmac.new(key, f"{name}:{n}:{r}".encode(), hashlib.sha256) for r in range(ROUNDS)]

    def round(self, r: int, x: int) -> int:
        size = -(-self.half // 8)
        body, out, i = x.to_bytes(size, "big"), b"", 0
        while len(out) < size:  # a digest has 32 bytes
            h = self.keys[r].copy()
            h.update(body + bytes([i]))
            out, i = out + h.digest(), i + 1
        return int.from_bytes(out[:size], "big") & ((1 << self.half) - 1)

    def forth(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & ((1 << self.half) - 1)
            for r in range(ROUNDS):
                a, b = b, a ^ self.round(r, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def back(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & ((1 << self.half) - 1)
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self.round(r, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return self.back((self.forth(x) + 1) % self.n) if self.n > 1 else x

    def undo(self, x: int) -> int:
        return self.back((self.forth(x) - 1) % self.n) if self.n > 1 else x


def luhn_digit(body: str) -> int:
    """Check digit that makes body + digit valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def refilled(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in layout)


class Pseudonyms:
    """Finds values and replaces each by its pseudonym of the same kind and format."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutations: dict[tuple[str, int], Permutation] = {}
        self.kept: OrderedDict[tuple[str, str], tuple[str, str] | None] = OrderedDict()

    def of(self, name: str, n: int) -> Permutation:
        if (name, n) not in self.permutations:
            if len(self.permutations) > 4096:
                self.permutations.clear()
            self.permutations[name, n] = Permutation(self.key, name, n)
        return self.permutations[name, n]

    def walked(self, name: str, n: int, x: int, valid, undo: bool = False) -> int:
        """Permuted until valid again: a permutation of the valid values."""
        p = self.of(name, n)
        step = p.undo if undo else p
        y = step(x)
        while not valid(y):
            y = step(y)
        return y

    def email(self, v: str, undo: bool) -> tuple[str, str]:
        """Characters of the local part stay in their class; the domain stays.  Blocks after the first
        of a long local part are permuted under a key that depends on what stands before them."""
        local, domain = v.split("@", 1)
        form = "".join("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c for c in local)
        name, plain, out = f"email:{domain.lower()}:{form}", "", ""
        for at in range(0, len(local), EMAIL_BLOCK):
            block, shape = local[at : at + EMAIL_BLOCK], form[at : at + EMAIL_BLOCK]
            radix = [26 if f in "aA" else 10 if f == "9" else 1 for f in shape]
            zero = [ord("0") if f == "9" else ord(f) for f in shape]
            x, n = 0, 1
            for c, r, z in zip(block, radix, zero, strict=True):
                x, n = x * r + ord(c) - z, n * r
            if n > 1:
                p = Permutation(self.key, f"{name}:{plain}", n) if at else self.of(name, n)
                x = p.undo(x) if undo else p(x)
            new = []
            for r, z in zip(reversed(radix), reversed(zero), strict=True):
                x, d = divmod(x, r)
                new.append(chr(z + d))
            out += "".join(reversed(new))
            plain += out[at:] if undo else block
        return "email", out + "@" + domain

    def iban(self, v: str, undo: bool) -> tuple[str, str] | None:
        plain = v.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
            return None
        country, body = plain[:2], plain[4:]
        digits = "".join(c for c in body if c.isdigit())
        if not digits:
            return None
        p = self.of(f"iban:{country}:{re.sub('[0-9]', '9', body)}", 10 ** len(digits))
        new = refilled(body, str((p.undo if undo else p)(int(digits))).zfill(len(digits)))
        check = 98 - mod97(country + "00" + new)
        return "iban", refilled(v[:2], "") + refilled(v[2:], f"{check:02d}" + "".join(c for c in new if c.isdigit()))

    def date(self, v: str, undo: bool) -> tuple[str, str] | None:
        parts = re.split(r"[-/.]", v)
        orders = [(0, 1, 2)] if "-" in v else [(2, 0, 1), (2, 1, 0)] if "/" in v else [(2, 1, 0)]
        for y, m, d in orders:  # 3/4/2020 is read as March; 13/4/2020 can only be a day first
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal()
            except ValueError:
                continue
            near = FIRST <= day <= LAST
            style = (y, m, d, len(parts[m]), len(parts[d])) if near else (y, m, d, len(parts[m]), len(parts[d]), "other years")
            days = LAST - FIRST + 1
            place = lambda t: t - FIRST if near else t - 1 if t < FIRST else t - 1 - days  # noqa: B023, E731
            at = lambda x: datetime.date.fromordinal(FIRST + x if near else x + 1 if x + 1 < FIRST else x + 1 + days)  # noqa: B023, E731

            def valid(x: int) -> bool:
                """Written in the same way, and read in the same order."""
                t = at(x)
                return len(str(t.month)) <= len(parts[m]) and len(str(t.day)) <= len(parts[d]) and ((y, m, d) != (2, 1, 0) or "/" not in v or t.day > 12)

            sign = "-" if "-" in v else "/" if "/" in v else "."
            t = at(self.walked(f"date:{style}:{v[4] if sign == '-' else sign}", days if near else datetime.date.max.toordinal() - days, place(day), valid, undo))
            out = ["", "", ""]
            out[y], out[m], out[d] = f"{t.year:04d}", str(t.month).zfill(len(parts[m])), str(t.day).zfill(len(parts[d]))
            return "date", sign.join(out)
        return None

    def ip(self, v: str, undo: bool) -> tuple[str, str] | None:
        octets = [int(x) for x in v.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
            return None
        p = self.of("ip", 1 << 32)
        x = (p.undo if undo else p)(int.from_bytes(bytes(octets), "big"))
        return "ip", ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, v: str, undo: bool) -> tuple[str, str] | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        x = int(v.replace("-", ""))
        return ("ssn", refilled(v, f"{self.walked('ssn', 10**9, x, valid, undo):09d}")) if valid(x) else None

    def phone(self, v: str, undo: bool) -> tuple[str, str] | None:
        """The country's code stays; the national digits are permuted within the layout."""
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", v)
        start = head.end() if head else 2 if v[0] == "+" else 0
        digits = re.sub("[^0-9]", "", v[start:])
        if not 6 <= len(digits) <= 14:
            return None
        p = self.of(f"phone:{re.sub('[^0-9]', '', v[:start])}", 10 ** len(digits))
        return "phone", v[:start] + refilled(v[start:], str((p.undo if undo else p)(int(digits))).zfill(len(digits)))

    def card(self, v: str, undo: bool) -> tuple[str, str] | None:
        """Numbers with a valid check digit keep one; others, such as accounts, get none."""
        digits = re.sub("[^0-9]", "", v)
        k = len(digits)
        if luhn_digit(digits[:-1]) == int(digits[-1]):
            p = self.of(f"card:{k}", 10 ** (k - 1))
            body = str((p.undo if undo else p)(int(digits[:-1]))).zfill(k - 1)
            return "card", refilled(v, body + str(luhn_digit(body)))
        valid = lambda x: luhn_digit(str(x // 10).zfill(k - 1)) != x % 10
        return "account", refilled(v, str(self.walked(f"account:{k}", 10**k, int(digits), valid, undo)).zfill(k))

    def value(self, kind: str, v: str, undo: bool) -> tuple[str, str] | None:
        if undo:
            return getattr(self, kind)(v, True)
        at = kind, v
        if at not in self.kept:
            if len(self.kept) >= CACHED_VALUES:
                self.kept.popitem(last=False)
            self.kept[at] = getattr(self, kind)(v, False)
        return self.kept[at]

    def replaced(self, text: str, undo: bool = False) -> tuple[str, dict[str, int]]:
        """The text with every value replaced, and how many of each kind."""
        found: list[tuple[int, int, str, str]] = []
        if "@" in text:
            at = text.find("@")
            while at >= 0:  # the pattern is tried only around the sign
                lo = at
                while lo and (c := text[lo - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                    lo -= 1
                m = EMAIL.match(text, lo)
                if m and m.end() > at and (got := self.value("email", m[0], undo)):
                    found.append((lo, m.end(), *got))
                at = text.find("@", max(at + 1, m.end() if m else 0))
        rest = text  # without the account numbers found
        for sized in (True, False):
            at = 0
            while m := IBAN.search(rest, at):
                at = m.start() + 1
                for end in iban_ends(m, sized):
                    if got := self.value("iban", text[m.start() : end], undo):
                        found.append((m.start(), end, *got))
                        rest, at = rest[: m.start()] + "x" * (end - m.start()) + rest[end:], end
                        break
        for s in STRETCH.finditer(rest):
            lo, hi = s.span()
            if lo and rest[lo - 1] < "\x7f" and rest[lo - 1].isalnum():
                lo = next((i for i in range(lo, hi) if rest[i] in " ():/+"), hi)  # the rest of a word
            if hi < len(rest) and rest[hi] < "\x7f" and (rest[hi].isalnum() or rest[hi] == "_"):
                while hi > lo and rest[hi - 1] not in " ():/+":
                    hi -= 1  # the start of a word
            at = lo
            while m := NUMBER.search(rest, at, hi):
                got = self.value(m.lastgroup, m[0], undo)
                if got is None and m.lastgroup != "card":
                    at = m.start() + 1
                    continue
                if got:
                    found.append((*m.span(), *got))
                at = m.end()
        if not found:
            return text, {}
        out, at, counts = [], 0, {}
        for lo, hi, kind, new in sorted(found):
            if lo >= at:
                out += [text[at:lo], new]
                at = hi
                counts[kind] = counts.get(kind, 0) + 1
        return "".join(out) + text[at:], counts


def pseudonymize(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every whole text with its personal values replaced by keyed pseudonyms.

    Addresses of mail and network, telephone, social security, card, account and bank numbers and
    dates are found, validated (check digits, calendar, ranges) and permuted within their format
    under ``key``: equal values get equal pseudonyms in all documents, different ones different
    ones, the layout stays, check digits hold again, and who has the key can reverse it
    (``Pseudonyms.replaced(..., undo=True)``).  What stays readable: the domain of an address, the
    country's code of a telephone number, and the country and letters of an account number.

    Returns id, the columns ``carry``, text, n_values and a count n_<kind> for each kind.  Row-wise: no shuffle, and a lost
    executor's rows come out the same again.  Null text stays null with no value; empty text stays
    empty; repeated rows have a row each; extra columns are left out.
    """
    if not key:
        raise ValueError("a key is needed")
    small_batches(docs.sparkSession)
    secret = key.encode()

    def run(batches):
        names = Pseudonyms(secret)
        for batch in batches:
            done = [(None, {}) if t is None else names.replaced(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            counts = [pa.array([c.get(k, 0) for _, c in done], pa.int64()) for k in KINDS]
            total = pa.array([sum(c.values()) for _, c in done], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in done], pa.string()), total, *counts], names=[id_column, *carry, "text", "n_values", *[f"n_{k}" for k in KINDS]])

    picked = docs.select(F.col(id_column), *map(F.col, carry), F.col(text))
    schema = T.StructType(picked.schema.fields[:-1]).add("text", "string").add("n_values", "long")
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return picked.mapInArrow(run, schema)
