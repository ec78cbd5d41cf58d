"""Personal data in free text: find it, and put a placeholder of its type in its place.

Regular expressions propose spans, checksum validators confirm numbers, and words nearby move the
score; spans at or above ``ACCEPT`` count. A number of a specific form that passes its checksum
needs no word beside it, one of a looser form only a word somewhere near; one that fails its
checksum, or has none, needs the naming word directly before it, and weak forms that fail it are
refused even then. Kinds are tried in a fixed order (email, address,
identity number, phone, name) and a later kind never takes what an earlier one has. Names need a
family name with a given name, an initial or a title; name parts come from a list and, as lists
are never complete, from the endings that are typical of the list's family and given names.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCEPT = 0.6
#: Name parts that may be broadcast; the list is checked against it.
NAME_PARTS = 200_000
KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

# --- email: signs may be written out or bracketed
_AT = r"(?:\s*@\s*|\s*[(\[{<]\s*(?:at|AT|@)\s*[)\]}>]\s*)"
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|DOT|\.)\s*[)\]}>]\s*)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL = re.compile(
    rf"(?<![\w.+@/-])[A-Za-z0-9][\w.+%'-]*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![\w@])"
    rf"|\s+(?:AT|at)\s+{_LABEL}(?:(?:\s+(?:DOT|dot)\s+|\.){_LABEL})*\s+(?:DOT|dot)\s+[A-Za-z]{{2,24}}\b"
    rf"|\s+AT\s+{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}\b)"
)
_URL = re.compile(r"\b(?:https?|ftp)://[^\s<>\"]+|\bwww\.[^\s<>\"]+")

# --- street address: a street with number, or a box, and a place
_NUM = r"\d{1,5}(?:\s?[A-Za-z])?(?:\s?[-–/]\s?\d{1,5}[A-Za-z]?)?"
_UNIT = r"(?:(?:Flat|FLAT|Apt\.?|APT\.?|Apartment|APARTMENT|Unit|UNIT|Suite|SUITE|Room|ROOM|Floor)\s*\#?\s*\d{1,4}[A-Za-z]?)"
_PROPER = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_TYPE = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|court|ct\.?|terrace|boulevard|blvd\.?|drive|close|place|square|sq\.?|crescent|parkway|highway|row|gardens|grove|way|walk|mews|hill)"
_CITY = r"[A-ZÀ-ÖØ-Þ][\w'’-]{2,}"
_PLACE = rf"(?:\d{{4,6}}\s+{_CITY}|{_CITY}(?:,?\s+\d{{4,6}}\b)?)"
_SEP = r"(?:\s*,\s*|\s*\n\s*|\s+[/–]\s+)"
_ADDRESS = re.compile(
    rf"(?:(?:{_UNIT}\s*,?\s*)?\b{_NUM},?\s+(?:{_PROPER}\s+){{1,3}}(?i:{_TYPE})(?![\w])(?:\s*,\s*{_UNIT})?{_SEP}{_PLACE}"
    rf"|\b{_PROPER[:-1]}*(?i:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer)\s+{_NUM}{_SEP}{_PLACE}"
    rf"|\b{_NUM},?\s+(?i:rue|avenue|boulevard|chemin|allée|quai|impasse)\s+(?:(?:de|du|des|la|le|les|d')\s*)*{_PROPER}{_SEP}{_PLACE}"
    rf"|\b(?i:calle|avenida|plaza|paseo|camino|via|viale|piazza|rua)\s+(?:(?:de|del|la|las|los|el)\s+)*{_PROPER},?\s+{_NUM}{_SEP}{_PLACE}"
    rf"|\b(?i:p\.?\s?o\.?\s?box|postfach|apartado|bo[iî]te postale|casella postale)\s*\#?\d{{1,6}}{_SEP}{_PLACE})"
)

# --- identity numbers
_IDENTITY_WORDS = (
    r"social security(?: (?:number|no\.?))?|ssn|aadhaar|aadhar|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e (?:number|no\.?)|national id(?:entity)?|identity card|id card|"
    r"steuer-?id(?:nr\.?)?|steuernummer|steueridentifikationsnummer|personalausweis|tax (?:id|number|no\.?)|taxpayer|tin|itin|ni number|ni no\.?|nino|national insurance|"
    r"passport|reisepass|pasaporte|passeport|pan|dni|nie|nif|curp|cpf|bsn|nhs|health (?:insurance|card|id)|medicare|krankenversicherung|sozialversicherung|insee|numéro de sécurité sociale|"
    r"identity (?:number|no\.?)|id (?:number|no\.?)|voter id|residence permit"
)
#: The same words anywhere near, with nothing that ends a sentence between.
_IDENTITY_NEAR = re.compile(rf"(?<![\w-])(?:{_IDENTITY_WORDS})(?![\w])(?:[^.;!?\n]|\.(?=\S))*$", re.I)
_IDENTITY_AFTER = re.compile(rf"^(?:[^.;!?\n]|\.(?=\S))*?(?<![\w-])(?:{_IDENTITY_WORDS})(?![\w])", re.I)
_IDENTITY_CUE = re.compile(rf"(?<![\w-])(?:{_IDENTITY_WORDS})(?![\w])\s*(?:card\s*)?(?:number|no\.?|nr\.?|id|is|was|#|:|=)?\s*[:#=]?\s*$", re.I)
_IDENTITY = re.compile(
    r"(?<![\w@/+.-])(?:"
    r"(?P<ssn>\d{3}([- ])\d{2}\2\d{4})"
    r"|(?P<twelve>\d{4}([- ])\d{4}\4\d{4})"
    r"|(?P<insee>[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2})"
    r"|(?P<belgian>\d{2}\.(?:0\d|1[0-2])\.\d{2}-\d{3}\.\d{2})"
    r"|(?P<sin>\d{3}(?P<gap>[- ])\d{3}(?P=gap)\d{3})"
    r"|(?P<pan>[A-Z]{5}\d{4}[A-Z])"
    r"|(?P<nino>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])"
    r"|(?P<licence>[A-Z]{5}\d{6}[A-Z0-9]{2,5})"
    r"|(?P<dni>[XYZ]?\d{7,8}-?[A-Z])"
    r"|(?P<steuer>\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<passport>[A-Z]{1,2}\d{6,8})"
    r"|(?P<nhs>\d{3} \d{3} \d{4})"
    r"|(?P<any>[A-Z]{0,3}\d[\dA-Z]{5,15})"
    r")(?![\w@]|[-.]\w)"
)
#: How sure the form alone is, before checksum and context.
_IDENTITY_BASE = {
    "ssn": 0.3, "twelve": 0.15, "insee": 0.35, "belgian": 0.35, "sin": 0.1, "pan": 0.35, "nino": 0.4, "licence": 0.3, "dni": 0.15, "steuer": 0.15, "passport": 0.1, "nhs": 0.05, "any": 0.0,
}
#: Forms with a checksum or rule of issue: passing it adds, failing it takes away.
_CHECKED = frozenset(("ssn", "twelve", "insee", "belgian", "sin", "dni", "steuer", "nhs"))
_PASSED, _FAILED, _CUE, _NEAR, _AGAINST = 0.3, 0.1, 0.6, 0.35, 0.6

# --- phone numbers
_PHONE = re.compile(
    r"(?<![\w@/.:=#-])(?:"
    r"(?P<intl>(?:\+|00[ -]?)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){1,6})"
    r"|(?P<us>(?:1[-. ])?(?:\([2-9]\d{2}\)\s?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4})"
    r"|(?P<slash>0\d{2,4}\s?/\s?\d{3,8}(?:[- ]\d{1,4})?)"
    r"|(?P<pairs>0\d(?:[ .]\d{2}){4})"
    r"|(?P<trunk>\(?0\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4})"
    r"|(?P<bare>0?\d{9,11})"
    r")(?![\w@]|[-./:]\d)(?:\s*(?:ext\.?|x|extension|Durchwahl)\s*\d{1,6}\b)?"
)
_PHONE_BASE = {"intl": 0.6, "us": 0.5, "slash": 0.5, "pairs": 0.55, "trunk": 0.5, "bare": 0.1}
_PHONE_NEAR = re.compile(r"\b(?:phone|tel|telephone|telefon|teléfono|mobile|mobil|cell|fax|call|called|number|contact|reach|whatsapp|ring|dial|hotline|anruf)\b", re.I)
_NUMBER_AGAINST = re.compile(
    r"\b(?:order|ticket|trace|build|host|ratio|invoice|inv|version|digest|commit|case|sku|port|rows?|moved|lot|batch|serial|tracking|memory id|session|request|issue|release|isbn|iban|account)\b[^.;,\n]{0,12}$", re.I
)

# --- names
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "herr", "frau", "señor", "señora", "sr", "sra", "mme", "sir", "madam"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’](?!s\b)[^\W\d_]+)*(?:-[^\W\d_]+)*\.?")
_NOT_NAMES = frozenset(
    "about after again also always and another any are ask before between both but call can contact could deliver did does each every for form from had has have her here his how into its "
    "keep like limit mail main missed moved name never nobody none not nothing old once one only order other our over owner please plus recall said see send ship signed since some spoke "
    "such than that the their them then there these they this those through ticket too under until very was were what when where which while who why will with within without write you your "
    "tel attn filed remember reported identity file host build ratio phone number".split()
)
#: Forms of companies and offices, and kinds of streets, that follow a name.
_COMPANY = re.compile(
    r"^[\s,&]*(?:&|and sons\b|sons\b|brothers\b|holdings?\b|ltd\b|limited\b|llc\b|llp\b|inc\b|plc\b|gmbh\b|ag\b|corp\b|corporation\b|company\b|co\b|group\b|partners\b|associates\b|board\b|desk\b|services?\b|"
    r"gateway\b|pipeline\b|street\b|st\b|road\b|rd\b|avenue\b|ave\b|lane\b|court\b|terrace\b|blvd\b|drive\b|square\b)",
    re.I,
)
#: A capitalised word right behind: with it the words name an organisation, unless it is a name part too.
_NEXT_CAPITAL = re.compile(r"^ ([A-Z][a-z]{2,})\b")
_NAME_BEFORE = re.compile(
    r"(?:\bname(?: is|\W{1,4})|\b(?:with|by|from|to|of|and|dear|cc|attn|contact|met|call|called|signed|reported|filed|file):?)\s*[\"']?\s*$|[\n;{\"]\s*$|^\s*$|[.!?]\s+$", re.I
)
_NAME_AFTER = re.compile(r"^[\"']?(?:'s\b|\s*[(<;]|,? (?:phone|mail|tel)\b|\s+(?:about|yesterday|today|this|last|next|can|will|lives|works|gave|asked|said|wrote|called|signed|sent)\b|\s*\"\s*,\s*\")", re.I)


def _verhoeff(digits: str) -> bool:
    """Dihedral-group checksum: permuted digits multiplied in D5 give the identity."""
    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
        return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5

    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        for _ in range(i % 8):
            d = step[d]
        total = times(total, d)
    return total == 0


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97_rest(digits: str) -> int:
    return int(digits) % 97


def _mod11_10(digits: str) -> bool:
    p = 10
    for ch in digits[:-1]:
        p = ((int(ch) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def _mod11(digits: str) -> bool:
    check = 11 - sum(int(c) * w for c, w in zip(digits, range(10, 1, -1), strict=False)) % 11
    return (check % 11) == int(digits[-1])


def confirmed(form: str, text: str) -> bool:
    """Whether the number passes the checksum of its form; forms without one are never confirmed."""
    digits = re.sub(r"\D", "", text)
    if form == "twelve":
        return _verhoeff(digits) or luhn(digits)
    if form == "steuer":
        return _mod11_10(digits)
    if form == "nhs":
        return _mod11(digits)
    if form == "dni":
        body = text.upper().replace("-", "")
        number = body[:-1].translate(str.maketrans("XYZ", "012"))
        return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == body[-1]
    if form == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if form == "insee":
        # The key is what the first 13 lack to a multiple of 97; the two Corsican departments count as 19 and 18.
        body = text.replace(" ", "").replace("2A", "19").replace("2B", "18")
        return mod97_rest(body[:13]) + int(body[13:]) == 97
    if form == "belgian":
        # Born from 2000 on, a 2 goes before.
        return any(mod97_rest(front + digits[:9]) + int(digits[9:]) == 97 for front in ("", "2"))
    if form in ("sin", "any"):
        return len(digits) >= 9 and text.replace("-", "").replace(" ", "").isdigit() and luhn(digits)
    return False


def identity_score(form: str, text: str, before: str, after: str) -> float:
    """How surely a span of a form is an identity number, by its checksum and the words around it."""
    digits = re.sub(r"\D", "", text)
    if len(digits) > 5 and len(set(digits)) == 1:
        return 0.0  # a filler such as 000-00-0000
    score = _IDENTITY_BASE[form]
    if confirmed(form, text):
        score += _PASSED
    elif form in _CHECKED:
        score -= _FAILED
    if _IDENTITY_CUE.search(before):
        return score + _CUE
    if _IDENTITY_NEAR.search(before) or _IDENTITY_AFTER.search(after):
        score += _NEAR
    return score - _AGAINST * bool(_NUMBER_AGAINST.search(before))


class Lexicon:
    """Known name parts, and endings typical of them."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.family = frozenset(p.lower() for p, k in rows if k == "family")
        self.given = frozenset(p.lower() for p, k in rows if k == "given")
        self.family_ends = self._endings(self.family, self.given, (5, 4, 3), max(3, len(self.family) // 60))
        self.given_ends = self._endings(self.given, self.family, (3, 2), max(3, len(self.given) // 60))
        self.memo: dict[str, tuple[float, float]] = {}

    @staticmethod
    def _endings(own: frozenset, other: frozenset, lengths: tuple[int, ...], least: int) -> frozenset:
        out = set()
        for n in lengths:
            mine, theirs = Counter(w[-n:] for w in own if len(w) > n), Counter(w[-n:] for w in other if len(w) > n)
            out |= {e for e, c in mine.items() if c >= least and theirs[e] <= c / 20}
        return frozenset(out)

    def part(self, token: str) -> tuple[float, float]:
        """(evidence for a family name, for a given name) of one token, hyphens taken apart."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[token] = self._part(token)
        return got

    def _part(self, token: str) -> tuple[float, float]:
        parts = token.lower().split("-")
        if any(len(p) < 2 or p in _NOT_NAMES for p in parts):
            return 0.0, 0.0
        family = [0.5 if p in self.family else 0.4 if len(p) > 3 and any(p.endswith(e) and len(p) > len(e) + 1 for e in self.family_ends) else 0.0 for p in parts]
        given = [0.4 if p in self.given else 0.2 if 3 < len(p) < 12 and any(p.endswith(e) for e in self.given_ends) else 0.0 for p in parts]
        f = max(family) if min(family) > 0 else 0.0
        g = max(given) if min(given) > 0 else 0.0
        return f, g


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(a < y and x < b for x, y in taken)


def _names(text: str, lexicon: Lexicon, taken: list[tuple[int, int]], mail_near: bool) -> list[tuple[int, int, float]]:
    tokens = []
    hot = False
    for m in _TOKEN.finditer(text):
        word = m.group()
        bare = word.rstrip(".")
        f, g = lexicon.part(bare)
        hot = hot or f > 0
        tokens.append((m.start(), m.start() + len(bare), m.end(), bare, f, g))
    if not hot:
        return []
    out = []
    i = 0
    while i < len(tokens):
        best = None
        for n, score in _readings(text, tokens, i, lexicon):
            a, b = tokens[i][0], tokens[i + n - 1][1]
            if _overlaps(taken, a, b) or (_COMPANY.match(text[b : b + 20]) and not text[b : b + 2].startswith(".")):
                continue
            behind = _NEXT_CAPITAL.match(text[b : b + 24])
            if behind and not any(lexicon.part(behind[1])):
                continue
            if _NAME_BEFORE.search(text[max(0, a - 24) : a]):
                score += 0.1
            if _NAME_AFTER.match(text[b : b + 24]):
                score += 0.2
            if score >= ACCEPT + 0.1 and (best is None or (n, score) > best):
                best = (n, score)
        if best:
            n, score = best
            out.append((tokens[i][0], tokens[i + n - 1][1], score))
            i += n
        else:
            i += 1
    return out


def _gap(text: str, left: tuple, right: tuple) -> str:
    return text[left[1] : right[0]]


def _readings(text: str, tokens: list[tuple], i: int, lexicon: Lexicon) -> Iterator[tuple[int, float]]:
    """(number of tokens, score) of every way to read a name that starts at token i."""
    t = tokens[i]
    nxt = tokens[i + 1] if i + 1 < len(tokens) else None
    if nxt is None:
        return
    third = tokens[i + 2] if i + 2 < len(tokens) else None
    gap = _gap(text, t, nxt)
    close = gap in (" ", ". ") or (gap.strip() == "" and len(gap) <= 2)
    cased = nxt[3][0].isupper()
    if t[3].lower() in _TITLES and close and t[3][0].isupper():
        if nxt[4] and cased:
            yield 2, 0.4 + nxt[4]
        if third and _gap(text, nxt, third) in (" ", ". ") and third[4] and third[3][0].isupper():
            if len(nxt[3]) == 1 or nxt[5] or cased:
                yield 3, 0.4 + third[4] + nxt[5]
        # Title, given, initial, family.
        if third and i + 3 < len(tokens) and len(third[3]) == 1 and tokens[i + 3][4] and _gap(text, third, tokens[i + 3]) in (" ", ". "):
            yield 4, 0.4 + tokens[i + 3][4]
        return
    if len(t[3]) == 1 and t[3].isupper() and gap == ". ":
        if nxt[4] and cased:
            yield 2, 0.3 + nxt[4]
        if third and len(nxt[3]) == 1 and third[4] and _gap(text, nxt, third) == ". ":
            yield 3, 0.3 + third[4]
        return
    mixed = 0.0 if t[3][0].isupper() and (cased or nxt[3][0].isupper()) else -0.1
    if gap == " " and nxt[4] and t[3].lower() not in _NOT_NAMES:
        upper = t[3][0].isupper()
        if t[5] or upper:
            # An unknown lower-case word is no given name.
            known = t[5] if upper or t[5] >= 0.4 else t[5] - 0.1
            ordinary = not cased and nxt[4] >= 0.5 and not any(nxt[3].lower().endswith(e) for e in lexicon.family_ends)
            yield 2, (known or 0.1) + nxt[4] - (0.2 if ordinary else 0.0)
        # A second family name without hyphen.
        if third and t[5] and _gap(text, nxt, third) == " " and third[4] and third[3][0].isupper() and cased and not third[5]:
            yield 3, t[5] + nxt[4] + mixed
    if third and gap == " " and (t[5] or t[3][0].isupper()) and t[3].lower() not in _NOT_NAMES:
        g2 = _gap(text, nxt, third)
        if len(nxt[3]) == 1 and nxt[3].isupper() and g2 in (" ", ". ") and third[4]:
            yield 3, max(t[5], 0.2) + 0.2 + third[4]
        elif g2 == " " and t[5] >= 0.2 and nxt[5] >= 0.2 and third[4] and t[3][0].isupper() == third[3][0].isupper() and nxt[4] == 0:
            yield 3, t[5] + third[4]
    if t[4] and re.fullmatch(r",\s?", gap):
        same = t[3][0].isupper() == cased
        if nxt[5] and same and nxt[3].lower() not in _NOT_NAMES and not (third and third[4] and _gap(text, nxt, third) == " " and third[3][0].isupper()):
            yield 2, t[4] + nxt[5] + (0.0 if cased else -0.1)
        elif len(nxt[3]) == 1 and cased and text[nxt[1] : nxt[1] + 1] == ".":
            yield 2, t[4] + 0.3


def spans(text: str | None, lexicon: Lexicon) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all personal data in ``text``, in order; null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[int, int, str, float]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str, score: float) -> None:
        found.append((a, b, kind, score))
        taken.append((a, b))

    lowered = "@" in text or "at" in text or "AT" in text
    mails = list(_EMAIL.finditer(text)) if lowered else []
    urls = [m.span() for m in _URL.finditer(text)] if "://" in text or "www." in text else []
    for m in mails:
        if not _overlaps(urls, *m.span()):
            add(*m.span(), "email", 0.9)
    taken.extend(urls)
    if any(c.isdigit() for c in text):
        for m in _ADDRESS.finditer(text):
            if not _overlaps(taken, *m.span()):
                add(*m.span(), "street_address", 0.8)
        for m in _IDENTITY.finditer(text):
            if _overlaps(taken, *m.span()):
                continue
            form = next(f for f in _IDENTITY_BASE if m.group(f) is not None)
            score = identity_score(form, m.group(), text[max(0, m.start() - 48) : m.start()], text[m.end() : m.end() + 32])
            if score >= ACCEPT:
                add(*m.span(), "identity_number", min(score, 1.0))
        for m in _PHONE.finditer(text):
            a, b = m.span()
            if text[a] == "(" and ")" not in m.group():
                a += 1
            if _overlaps(taken, a, b):
                continue
            form = m.lastgroup
            n = len(re.sub(r"\D", "", re.split(r"(?i)\s*(?:ext|x)", m.group())[0]))
            if not 8 <= n <= 15 or form == "trunk" and n > 11:
                continue
            before = text[max(0, a - 32) : a]
            score = _PHONE_BASE[form] + 0.4 * bool(_PHONE_NEAR.search(before)) + 0.1 * (n in (10, 11, 12)) - 0.6 * bool(_NUMBER_AGAINST.search(before))
            if score >= ACCEPT:
                add(a, b, "phone", min(score, 1.0))
    for a, b, score in _names(text, lexicon, taken, bool(mails)):
        add(a, b, "person_name", min(score, 1.0))
    return sorted(found)


def redacted(text: str | None, lexicon: Lexicon) -> str | None:
    """``text`` with every span replaced by ``[KIND]``; all else unchanged."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind, _ in spans(text, lexicon):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def load_lexicon(name_parts: DataFrame) -> Lexicon:
    """The name list, checked to be under ``NAME_PARTS`` rows before it goes to the workers."""
    n = name_parts.count()
    if n > NAME_PARTS:
        raise ValueError(f"{n} name parts; at most {NAME_PARTS} can be broadcast")
    rows = name_parts.where("name_part is not null").select("name_part", "part_kind").distinct().collect()
    return Lexicon([(r[0], r[1]) for r in rows])


def _find(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    lexicon = known.value
    for batch in batches:
        rows, kinds, numbers, starts, ends, scores = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            counts: Counter = Counter()
            for a, b, kind, score in spans(text, lexicon):
                counts[kind] += 1
                rows.append(i)
                kinds.append(kind)
                numbers.append(counts[kind])
                starts.append(a)
                ends.append(b)
                scores.append(score)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(scores, pa.float64())],
            names=["id", "kind", "item_no", "start", "end", "score"],
        )


def find_personal_data(records: DataFrame, name_parts: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """``(id, kind, item_no, start, end, score)``: one row per occurrence; ``item_no`` counts a kind within a text from 1.

    Whole texts are read; null and empty ones have no rows. Rows repeated under one id with the
    same text give the same rows again. Other columns are ignored.
    """
    src = records.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = src.schema["id"].dataType.simpleString()
    known = records.sparkSession.sparkContext.broadcast(load_lexicon(name_parts))
    return src.mapInArrow(functools.partial(_find, known=known), f"id {kind}, kind string, item_no int, start int, end int, score double")


def _replace(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    lexicon = known.value
    for batch in batches:
        texts = [redacted(t, lexicon) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def redact(records: DataFrame, name_parts: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """``(ident, text)``: every row with its personal data replaced by typed placeholders; null stays null."""
    src = records.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    known = records.sparkSession.sparkContext.broadcast(load_lexicon(name_parts))
    return src.mapInArrow(functools.partial(_replace, known=known), f"id {kind}, text string").withColumnsRenamed({"id": ident, "text": text})
