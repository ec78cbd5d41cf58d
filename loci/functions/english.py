"""English analysis: stop words and the published Porter2 stemming rules, Arrow-batched."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the English text-search configuration.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don should now".split()
)
# Fixed values of the algorithm.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWEL = "aeiouy"


def _region(word: str, start: int = 0) -> int:
    """First place after a non-vowel that follows a vowel, from ``start`` on."""
    m = re.compile(f"[{_VOWEL}][^{_VOWEL}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(f"(?:^[{_VOWEL}][^{_VOWEL}]|[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY])$", word))


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = re.sub(f"^y|(?<=[{_VOWEL}])y", "Y", w)
    prefix = re.match(r"gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWEL}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w.lower()
    if w.endswith(("eed", "eedly")):
        base = w[: w.rindex("eed")]
        if len(base) >= r1:
            w = base + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search(f"[{_VOWEL}]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    w = re.sub(f"(?<=.)(?<=[^{_VOWEL}])[yY]$", "i", w) if len(w) > 2 else w
    for end, new in _STEP2:
        if w.endswith(end):
            base = w[: -len(end)]
            allowed = end not in ("ogi", "li") or (end == "ogi" and base.endswith("l")) or (end == "li" and base[-1:] in tuple("cdeghkmnrt"))
            if len(base) >= r1 and allowed:
                w = base + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r1 and (end != "ative" or len(base) >= r2):
                w = base + new
            break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_end(base)):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def analyse(text: str | None) -> list[str]:
    """Stems of the words that are no stop words, in order."""
    return [stem(w) for w in _WORD.findall(text.lower()) if w not in STOP] if text else []


def _batch(texts: pd.Series) -> pd.Series:
    return texts.map(analyse)


def lexemes(text: Column) -> Column:
    """``analyse`` as a Column."""
    return F.pandas_udf(_batch, "array<string>")(text)
