"""Text: accents, comparable names, keywords, keys."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _marked() -> tuple[str, str]:
    """Letters that Unicode decomposes into one letter and marks, and these letters: by rule, for the whole basic plane."""
    found = []
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if 0xAC00 <= code <= 0xD7A3 or len(parts) < 2:  # Hangul syllables have no marks
            continue
        if unicodedata.category(parts[0])[0] == "L" and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            found.append((chr(code), parts[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


MARKED, PLAIN = _marked()


def without_accents(text: Column) -> Column:
    """Letters lose their marks, also marks that stand as characters of their own."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{Mn}", "")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; text that is not so stays.

    Only the two-byte letters of the Latin-1 range are affected, and each has its own pair of characters.
    """
    for code in range(0xA0, 0x100):
        pair = chr(code).encode("utf-8").decode("latin-1")
        if chr(code) in MARKED:
            text = F.replace(text, F.lit(pair), F.lit(chr(code)))
    return text


def comparable(text: Column) -> Column:
    """Repaired, without accents, lower case, letters, digits and single spaces only."""
    plain = F.lower(without_accents(repaired(text)))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the accent-free lower-case text contains any of the words."""
    pattern = "|".join(w.replace(".", r"\.") for w in words)
    return F.coalesce(F.rlike(F.lower(without_accents(text)), F.lit(pattern)), F.lit(False))


def quoted_name(text: Column) -> Column:
    """The first name in double (or typographic) quotes, in upper case; NULL if there is none."""
    return F.nullif(F.upper(F.trim(F.regexp_extract(text, '["“”]([^"“”]+)["“”]', 1))), F.lit(""))


def code5(code: Column) -> Column:
    """An integer code as a key of five digits."""
    return F.lpad(code.cast("int").cast("string"), 5, "0")


def column_name(name: str) -> str:
    """Lower case; white space, hyphens and slashes become single underscores."""
    import re

    return re.sub(r"_+", "_", re.sub(r"[\s\-/]+", "_", name.strip().lower())).strip("_")
