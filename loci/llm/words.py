"""Words and stable word hashes, as the Python workers see them."""

from __future__ import annotations

import re

import xxhash

#: Characters removed from both ends of a word; fixed values.
EDGE = ".,;:!?\"'()[]{}<>"
_RUN = re.compile(r"[^\W_]+")


def edge_words(text: str | None) -> list[str]:
    """Lower case, split at white space, edges trimmed, empty ones dropped."""
    if not text:
        return []
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def run_words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _RUN.findall(text.lower()) if text else []


class Hasher(dict):
    """word -> signed 64-bit hash, remembered; forgets all at a bounded number of words."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        h -= (h >> 63) << 64
        self[word] = h
        return h
