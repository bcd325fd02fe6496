"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds email, ip, card and phone are the base: what their pattern and their check accept is always a span. iban
(mod 97) and ssn are added by the method; an iban stands by its checksum, an ssn only with a context word nearby.
Positions count code points, the end is exclusive. Matches of a kind are leftmost and do not overlap; a match that
fails its check is dropped and not tried again. All scans take time linear in the text, whatever it holds.

Edge cases: null texts count as empty and have no spans; equal rows give equal results; very long texts are scanned whole;
an empty table gives no rows; the output has doc_id and spans only, whatever else the input holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galerna.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
CONTEXT_CHARS = 40

#: The country code and the length of an IBAN of that country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

#: Score of a span by its pattern and check alone, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_GAIN = 0.3
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match in a run of digits starts at its beginning, which spares trying every digit of a long run
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ssn = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_digit = re.compile(r"[0-9]")
_not_digit = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part reaches back from an @ as far as its characters do, but not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _ip.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _card.finditer(text):
        digits = _not_digit.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _phone.finditer(text):
        if 10 <= len(_not_digit.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _iban.finditer(text):
        code = m.group().replace(" ", "")
        length = IBAN_LENGTHS.get(code[:2])
        if length is None or len(code) < length:
            continue
        end, left = m.start(), length  # the pattern may run on into the next word
        while left:
            left -= text[end] != " "
            end += 1
        if (end == len(text) or not text[end].isalnum()) and mod97(code[:length]):
            yield m.start(), end


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _ssn.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    said = any(re.search(rf"\b{w}", near) for w in CONTEXT[kind])
    return min(1.0, PRIOR[kind] + CONTEXT_GAIN * said)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed in KINDS."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    if "@" in text:
        spans += [(s, 0, e) for s, e in _emails(text)]
    if _digit.search(text):
        for k, scan in ((1, _ips), (2, _cards), (4, _ibans), (5, _ssns)):
            spans += [(s, k, e) for s, e in scan(text)]
        if "+" in text:
            spans += [(s, 3, e) for s, e in _phones(text)]
    out = []
    for s, k, e in sorted(spans):
        score = _score(KINDS[k], text, s, e)
        if k < len(BASE) or score >= THRESHOLD:
            out.append((KINDS[k], s, e, score))
    return out


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()),
]))


def detect(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, score)."""

    def rows(ids: list, texts: list) -> Iterator[tuple]:
        for d, t in zip(ids, texts):
            yield d, [dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)]

    schema = T.StructType([df.schema[doc_id], T.StructField("spans", SPANS)])
    return map_rows(df.select(doc_id, F.col(text).cast("string").alias("__text")), schema, rows)


def mask_text(text: str | None) -> str | None:
    """Replace each span by its kind in brackets; of overlapping spans the union, named by the first one's kind."""
    if not text:
        return text
    parts, done = [], 0
    for kind, start, end, _ in find(text):
        if start >= done:
            parts += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` with the spans of ``text`` masked; all other columns, and null texts, stay as they are."""
    at = df.columns.index(text)

    def rows(*columns: list) -> Iterator[tuple]:
        return zip(*columns[:at], [mask_text(t) for t in columns[at]], *columns[at + 1 :])

    return map_rows(df, df.schema, rows)
