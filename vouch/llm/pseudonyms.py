"""Pseudonyms that keep the format: keyed Feistel permutations of validated values.

A value is recognised by its form and by its own rules (a card number by its
check digit, an address by its octets, a date by the calendar, ...).  Its
digits or letters are numbered within the set of valid values of the same
format, the number is permuted by a keyed Feistel network (walking on until it
is valid again), and the new value is written in the old layout.  The
permutation depends on the key and the kind alone, so equal values get equal
pseudonyms in every document and layout, different values get different ones,
and the holder of the key can turn them back.  Only where digits that touch a
value would form a valid one together with its pseudonym is it permuted once
more, so that it can still be turned back.

Every form is of bounded length, so a text is searched in time that grows with
its length alone (the local part of an address has at most 64 characters, and a
longer one is no address).

What changes: the local part of e-mail addresses, phone numbers (three, three
and four digits with any area code, and numbers of any country after a ``+``,
whose country code stays), IPv4 addresses, card numbers (the network digit stays, the check digit is made
anew), social security numbers, IBANs (country stays, check digits are made
anew), calendar dates, and hexadecimal secrets after ``password=``,
``token = "`` and the like.  Numbers that break the rules of their kind stay.

Results: a null text stays null, an empty one empty; equal texts get equal
results; a text of any length is read whole; no documents give no rows.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import small_batches

_ROUNDS = 8
_FIRST_DAY = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2100, 1, 1).toordinal() - _FIRST_DAY
# Lengths of IBANs by country.
_IBAN = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 "
    "GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 "
    "MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 "
    "UA29 VA22 VG24 XK20 YE30").split()}

#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
                  "90 91 92 93 94 95 98".split())

_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63})"
    r"|(?P<secret>(?i:password|passwd|pwd|secret|token|api_?key|access_?key)\s?[=:]\s?\"?(?P<hex>[0-9a-f]{8,128})(?![\w]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w.+])\+[1-9](?:[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{2,5}\)|\d)){3,14}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<iso>(?<![\w-])(?:19|20)\d\d-\d\d-\d\d(?![\w-]))"
    r"|(?P<dmy>(?<![\w.])\d\d?\.\d\d?\.(?:19|20)\d\d(?!\w|\.\d))"
    r"|(?P<mdy>(?<![\w/])\d\d?/\d\d?/(?:19|20)\d\d(?![\w/]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))")

#: A text without any of these can hold no value of the pattern.
_ANY = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)\s?[=:]")


class Permuter:
    """Keyed permutations of [0, size), one for every kind."""

    def __init__(self, key: bytes) -> None:
        self._key = blake2b(key, digest_size=32).digest()
        self.number = lru_cache(maxsize=1 << 16)(self._number)

    def _mix(self, kind: str, turn: int, half: int, bits: int) -> int:
        data = b"%s|%d|%x" % (kind.encode(), turn, half)
        size = -(-bits // 8)
        out, block = b"", 0
        while len(out) < size:
            out += blake2b(data + b"|%d" % block, key=self._key, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, kind: str, back: bool) -> int:
        low = bits // 2
        a, b = x >> low, x & ((1 << low) - 1)
        for turn in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            if back:
                a, b = b ^ self._mix(kind, turn, a, low), a
            else:
                a, b = b, a ^ self._mix(kind, turn, b, low)
        return a << low | b

    def _number(self, x: int, size: int, kind: str, back: bool = False) -> int:
        """Permute x within [0, size): walk the Feistel cycle until inside."""
        if size < 2:
            return x
        bits = max(2, (size - 1).bit_length())
        bits += bits & 1
        x = self._once(x, bits, kind, back)
        while x >= size:
            x = self._once(x, bits, kind, back)
        return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _written_into(layout: str, digits: str) -> str:
    """Replace the digits of ``layout`` in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _card(s: str, p: Permuter, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 2
    body = d[0] + str(p.number(int(d[1:-1]), 10 ** n, f"card{len(d)}{d[0]}", back)).zfill(n)
    return _written_into(s, body + luhn_digit(body))


def _ip(s: str, p: Permuter, back: bool) -> str | None:
    o = s.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in o) or not 1 <= int(o[0]) <= 223:
        return None
    x = ((int(o[0]) - 1) << 24) | int(o[1]) << 16 | int(o[2]) << 8 | int(o[3])
    x = p.number(x, 223 << 24, "ip", back)
    return f"{(x >> 24) + 1}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"


def _phone(s: str, p: Permuter, back: bool) -> str | None:
    d = re.sub(r"\D", "", s.replace("(0)", "()"))
    if s[0] != "+":
        code = len(d) - 10
    elif not 7 <= len(d) <= 15:
        return None
    else:
        code = 1 if d[0] in "17" else 2 if d[:2] in _TWO_DIGITS else 3
    n = len(d) - code
    # One kind for all layouts of the numbers of +1.
    kind = "phone" if n == 10 and d[:code] in ("", "1") else f"phone+{d[:code]}-{n}"
    new = d[:code] + str(p.number(int(d[code:]), 10 ** n, kind, back)).zfill(n)
    return "(0)".join(_layouts(s.split("(0)"), new))


def _layouts(parts: list[str], digits: str):
    """Each of ``parts`` with the next digits in the places of its own."""
    for part in parts:
        n = sum(c.isdigit() for c in part)
        yield _written_into(part, digits[:n])
        digits = digits[n:]


def _ssn(s: str, p: Permuter, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(p.number(x, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(s: str, p: Permuter, back: bool) -> str | None:
    c = s.replace(" ", "")
    if _IBAN.get(c[:2]) != len(c) or _iban_check(c[:2], c[4:]) != c[2:4]:
        return None
    body = _by_class(c[4:], p, "iban", back)
    new, at = c[:2] + _iban_check(c[:2], body) + body, 0
    out = []
    for x in s:
        out.append(x if x == " " else new[at])
        at += x != " "
    return "".join(out)


def _by_class(s: str, p: Permuter, kind: str, back: bool) -> str:
    """Permute the digits, the small and the capital letters of ``s``, each
    class as one number; the places of the classes are part of the format."""
    out = list(s)
    for name, alphabet in (("d", "0123456789"), ("l", "abcdefghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        at = [i for i, c in enumerate(s) if c in alphabet]
        if not at:
            continue
        base, x = len(alphabet), 0
        for i in at:
            x = x * base + alphabet.index(s[i])
        x = p.number(x, base ** len(at), f"{kind}-{name}{len(at)}", back)
        for i in reversed(at):
            x, r = divmod(x, base)
            out[i] = alphabet[r]
    return "".join(out)


def _email(s: str, p: Permuter, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    return _by_class(local, p, "email@" + domain.lower(), back) + "@" + domain


def _hex(s: str, p: Permuter, back: bool) -> str:
    return f"{p.number(int(s, 16), 16 ** len(s), f'hex{len(s)}', back):0{len(s)}x}"


def _date(y: str, m: str, d: str, p: Permuter, back: bool) -> dt.date | None:
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return dt.date.fromordinal(_FIRST_DAY + p.number(day.toordinal() - _FIRST_DAY, _DAYS, "date", back))


def _dotted(parts: list[str], order: str, sep: str, p: Permuter, back: bool) -> str | None:
    at = {k: parts[i] for i, k in enumerate(order)}
    new = _date(at["y"], at["m"], at["d"], p, back)
    if new is None:
        return None
    # One layout for a whole format, so that it can be turned back.
    return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[k] for k in order)


def replace_value(kind: str, s: str, p: Permuter, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where it is not valid."""
    if kind == "email":
        return _email(s, p, back)
    if kind == "iso":
        return _dotted(s.split("-"), "ymd", "-", p, back)
    if kind == "dmy":
        return _dotted(s.split("."), "dmy", ".", p, back)
    if kind == "mdy":
        return _dotted(s.split("/"), "mdy", "/", p, back)
    return {"card": _card, "ip": _ip, "phone": _phone, "ssn": _ssn, "iban": _iban, "hex": _hex}[kind](s, p, back)


def pseudonymise(text: str | None, p: Permuter, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    if not text or not _ANY.search(text):
        return text, []
    out, spans, at, size = [], [], 0, 0
    refused: list[tuple[str, int, int]] = []
    m = _PATTERN.search(text)
    while m:
        kind = "hex" if m.lastgroup in ("secret", "hex") else m.lastgroup
        start, end = m.span("hex") if kind == "hex" else m.span()
        new = None
        for stop in _ends(kind, text, start, end):
            new = _replaced(kind, text, start, stop, refused, p, back)
            if new is not None:
                break
            refused.append((kind, start, stop))
        if new is None:
            m = _PATTERN.search(text, m.start() + 1)
            continue
        refused = []
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, len(new)))
        size += len(new)
        at = stop
        m = _PATTERN.search(text, at)
    return "".join([*out, text[at:]]), spans


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value of the match may end, the longest first: an IBAN at the
    length of its country, a card number also after fewer groups of digits if
    all but the last have four at least."""
    if kind == "iban":
        places = [i for i in range(start, end) if text[i] != " "]
        n = _IBAN.get(text[start:start + 2], 0)
        return [places[n - 1] + 1] if 0 < n <= len(places) and not text[places[n - 1] + 1:][:1].isalnum() else []
    if kind != "card":
        return [end]
    ends, digits = [], 0
    for group in re.finditer(r"\d+", text[start:end]):
        digits += len(group[0])
        if digits >= 13 and start + group.end() < end:
            ends.append(start + group.end())
        if len(group[0]) < 4:
            break
    return [end, *reversed(ends)]


def _replaced(kind: str, text: str, start: int, end: int, refused: list, p: Permuter, back: bool) -> str | None:
    """The pseudonym of text[start:end], permuted on while it makes a value of
    one of the spans ``refused`` before, so that it is found again."""
    new = replace_value(kind, text[start:end], p, back)
    if new is None:
        return None
    over = [(k, a, z) for k, a, z in refused if z > start]
    while any(replace_value(k, text[a:start] + (new + text[end:z] if z >= end else new[:z - start]), p) is not None for k, a, z in over):
        new = replace_value(kind, new, p, back)
    return new


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and found (kind, start, length)."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        p = Permuter(key)
        for b in batches:
            done = [pseudonymise(t, p, back) for t in b.column("text").to_pylist()]
            found = [[{"kind": k, "start": s, "length": n} for k, s, n in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for f in found], pa.int64()),
                 pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))],
                ["doc_id", "text", "n_found", "found"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, text string, n_found bigint, found array<struct<kind:string,start:bigint,length:bigint>>")
