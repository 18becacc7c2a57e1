"""Personal data in text: regular expressions propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavekit.llm.common import whole_text

#: Order of the kinds; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "card_short", "national_id")
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start at the first digit of a run (a later start would have matched from the first one too),
# so the look-behind and the possessive repeat change no match and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an account number by country.
_IBAN_LENGTHS = {
    k: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in names.split()
}
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

#: Words near a span that make a kind likelier; a span without checksum needs one.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "card_short": ("card", "visa", "mastercard", "amex", "karte", "tarjeta", "carte", "payment"),
    "national_id": ("ssn", "social", "security"),
}
WINDOW = 40
#: Score of a span by its pattern and checksum alone; a context word adds ``CONTEXT_BONUS``.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "card_short": 0.4, "national_id": 0.4}
CONTEXT_BONUS = 0.3
THRESHOLD = 0.6
_WORDS = re.compile(r"[^\W\d_]+")

Span = tuple[str, int, int, float, bool]


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = int(ch) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The account-number check: first four characters to the end, letters as 10 to 35, remainder 1."""
    rest = 0
    for ch in code[4:] + code[:4]:
        v = int(ch, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from their @ signs: linear however long a word without one is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 64 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the account number that passes mod 97 and ends where a word or group ends, as words and
    numbers behind it may look like further groups: of the country's length, and the longest where the country has
    none in the table."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        length = _IBAN_LENGTHS.get(m[0][:2])
        for end in sorted((x.end() for x in _IBAN_END.finditer(text, m.start(), m.end() + 1) if x.end() <= m.end()), reverse=True):
            code = text[m.start() : end].replace(" ", "")
            if len(code) < 15:
                break
            if length in (None, len(code)) and mod97(code):
                yield m.start(), end
                at = end
                break


def _further(text: str) -> Iterator[tuple[str, int, int]]:
    """What the method adds: account numbers by mod 97, shorter cards by Luhn, national numbers by context."""
    yield from (("iban", s, e) for s, e in _ibans(text))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 64 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d):
            yield "card_short", m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """(kind, start, end, score, base) in order of kind, then start; offsets in code points, end exclusive.

    Base spans always stay; the method's further ones need a score of ``threshold`` and no overlap with a base
    span. The score is the kind's prior, plus a bonus for a context word within 40 characters."""
    if not any(ch in text for ch in "@0123456789"):
        return []
    found: list[Span] = []
    taken: list[tuple[int, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end among the taken spans up to each start
    for base, source in ((True, _base), (False, _further)):
        for _, own in groupby(source(text), lambda x: x[0]):
            new = []
            for kind, s, e in own:
                near = text[max(0, s - WINDOW) : s] + " " + text[e : e + WINDOW]
                helped = any(w.lower() in CONTEXT[kind] for w in _WORDS.findall(near))
                score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * helped)
                # of the taken spans that start before this one's end, the furthest end says whether any overlaps
                k = bisect_left(starts, e) if not base else 0
                if base or (score >= threshold and not (k and reach[k - 1] > s)):
                    found.append((kind, s, e, score, base))
                    new.append((s, e))
            # spans of one kind don't overlap each other: they are put among the taken ones together
            taken = sorted(taken + new)
            starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``<id_col>, spans``: an array of (kind, start, end, score, base) for every row, in order of kind and start.

    Null text counts as empty and has no spans. Every row is looked at alone: repeated rows give repeated
    results, very long texts and long runs of digits or letters take linear time. Extra columns are ignored; an
    empty table gives an empty table."""
    kind = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

    @F.pandas_udf(kind)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "score", "base")
        return pd.Series([[dict(zip(names, s)) for s in find_spans(t, threshold)] for t in texts], dtype=object)

    return docs.select(F.col(id_col), spans(whole_text(text_col)).alias("spans"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``<id_col>, masked``: the texts with every span replaced by its kind in square brackets (of spans that
    overlap, the first; null counts as empty)."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            parts, at = [], 0
            for kind, s, e, _, _ in sorted(find_spans(t, threshold), key=lambda x: (x[1], -x[2])):
                if s >= at:
                    parts += [t[at:s], f"[{kind}]"]
                    at = e
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.select(F.col(id_col), masked(whole_text(text_col)).alias("masked"))
