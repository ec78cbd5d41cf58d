"""Entities named in a text: quoted spans, then runs of capitalised words."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loci.functions import lists as L

#: At most so many per memory; fixed values.
MOST, LEAST_CHARS, MOST_BYTES = 6, 2, 80

# Quoted spans; runs of capitalised words, with a small word between.
_QUOTED = re.compile(r"[\"“]([^\"”\n]{2,60})[\"”]")
_CAPITAL = r"[A-Z](?:[^\W_]|['’-])*"
_RUN = re.compile(rf"(?<![0-9A-Za-z_]){_CAPITAL}(?:\s+(?:of|the|de|van|von|del|la|le|and|&)\s+{_CAPITAL}|\s+{_CAPITAL})*")
_EDGE, _EDGE_DATE, _EDGE_NUMBER = ".,;:!?\"'“”()[]{}", ".,;:!?\"'", ".,;:!?%$"
_TEMPORAL, _NUMBERS, _OPENERS = frozenset(L.TEMPORAL), frozenset(L.NUMBER_WORDS), frozenset(L.SENTENCE_OPENERS)
_DIGITS = frozenset("0123456789")


def plausible(name: str) -> bool:
    """Two characters or more, 80 bytes or less, a letter in it, no date word, not only numbers."""
    words = name.lower().split()
    if len(name) < LEAST_CHARS or len(name.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return False
    if any(w.strip(_EDGE_DATE) in _TEMPORAL for w in words):
        return False
    bare = [w.strip(_EDGE_NUMBER) for w in words]
    if words and all(w in _NUMBERS or _DIGITS.issuperset(w) for w in bare):
        return False
    return any(c.isascii() and c.isalpha() or ord(c) > 127 for c in name)


def _key(name: str) -> str:
    base = name.lower().strip().strip(_EDGE)
    return " ".join(re.sub(r"['’]s$", "", base).split())


def _opens(text: str, at: int) -> bool:
    """Whether a sentence starts at a place: at the text's start, or behind a mark, perhaps a quote, and blanks."""
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    if end == 0:
        return at == 0
    mark = end - 1 - (text[end - 1] in "\"”'")
    return end < at and mark >= 0 and text[mark] in ".!?"


def find_entities(text: str | None) -> list[str]:
    """Up to six different names in order of discovery, as written: quoted ones first.

    A run that starts a sentence loses its first word if that is a common opener; names that differ
    in case or a possessive ending are one.
    """
    if not text:
        return []
    found: dict[str, str] = {}

    def add(name: str) -> None:
        name = name.strip(_EDGE).strip()
        if plausible(name) and (key := _key(name)):
            found.setdefault(key, name)

    quoted = []
    for m in _QUOTED.finditer(text):
        quoted.append(m.span())
        add(m.group(1))
    for m in _RUN.finditer(text):
        a, b = m.span()
        if any(a < y and x < b for x, y in quoted):
            continue
        span = m.group()
        first = re.split(r"[ \t]", span, maxsplit=1)[0]
        if first.lower() in _OPENERS and _opens(text, a):
            span = span[len(first) :]
        add(span)
    return list(found.values())[:MOST]


def _one_batch(texts: pd.Series) -> pd.Series:
    return texts.map(find_entities)


def entities(text: Column) -> Column:
    """Array of entity names, by an Arrow-batched function: it needs match positions, which Columns lack."""
    return F.pandas_udf(_one_batch, "array<string>")(text)
