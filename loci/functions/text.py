"""Text functions as Columns: tokens, hashes, rules, overlap, subsumption, contradiction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loci.functions import lists as L


def _words(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _edge_split(text: Column, trim: str) -> Column:
    pieces = F.split(F.lower(text), r"\s+")
    return F.transform(pieces, lambda w: F.btrim(w, F.lit(trim)))


def content_tokens(text: Column) -> Column:
    """Lower case, split at white space, edges trimmed, empty ones dropped. Null gives null."""
    return F.filter(_edge_split(text, L.TRIM_TOKEN), lambda w: w != "")


def content_hash(text: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the tokens joined by blanks; '' without tokens."""
    joined = F.array_join(content_tokens(text), " ")
    return F.when(text.isNull() | (joined == ""), F.lit("")).otherwise(F.substring(F.sha2(joined, 256), 1, 32))


def is_content_hash(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_plain_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F-]{36}$"), F.lit(False))


def normalize_entity(name: Column) -> Column:
    """Lower case, trimmed, one possessive ending dropped, blanks collapsed."""
    base = F.btrim(F.trim(F.lower(name)), F.lit(L.TRIM_ENTITY))
    base = F.regexp_replace(F.regexp_replace(base, "'s$", ""), "’s$", "")
    return F.trim(F.regexp_replace(base, r"\s+", " "))


def keywords(text: Column) -> Column:
    """Query words: trimmed, of two bytes or more, no stop words; repeated ones are kept."""
    stop = _words(*L.KEYWORD_STOP)
    return F.filter(_edge_split(text, L.TRIM_KEYWORD), lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w))


def embedding_tokens(text: Column) -> Column:
    stop = _words(*L.EMBED_STOP)
    return F.filter(_edge_split(text, L.TRIM_EMBED), lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w))


def significant_words(text: Column) -> Column:
    stop = _words(*L.SIGNIFICANT_STOP)
    kept = F.filter(_edge_split(text, L.TRIM_SIGNIFICANT), lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, w))
    return F.array_distinct(kept)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as BIGINT."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    places = F.when(F.length(digits) > 0, places).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(places, F.lit(2166136261).cast("bigint"), step)


def utterances(text: Column) -> Column:
    """Lines, and the pieces of a line that start with a speaker label after the end of a sentence."""
    marked = F.regexp_replace(text, r"([.!?])[ \t]+(?=[A-Z][A-Za-z0-9_]{0,28}: )", "$1\n")
    pieces = F.transform(F.split(marked, r"\n"), lambda p: F.trim(p))
    return F.filter(pieces, lambda p: p != "")


def strip_speaker(line: Column) -> Column:
    """Drop the label before the first ': ' if it is shorter than 30 bytes."""
    at = F.instr(line, ": ")
    label = F.octet_length(F.substring(line, F.lit(1), at - 1))
    return F.when((at > 1) & (label < 30), F.substring(line, at + 2, F.length(line))).otherwise(line)


def is_noise(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(L.NOISE) | (F.octet_length(text) < 15)


def _has_any(lowered: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | lowered.contains(m)
    return out


def classified(text: Column) -> Column:
    """Struct (type, tag) by the ordered rules; a null type is no memory."""
    low = F.lower(text)
    result = F.when(is_noise(text), F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("tag")))
    for kind, tag, marks in L.RULES:
        result = result.when(_has_any(low, marks), F.struct(F.lit(kind).alias("type"), F.lit(tag).cast("string").alias("tag")))
    long = F.when(F.octet_length(text) > 30, F.lit("episodic"))
    return result.otherwise(F.struct(long.alias("type"), F.lit(None).cast("string").alias("tag")))


def topics(text: Column) -> Column:
    """The first four different technical terms among the words."""
    known = _words(*L.TOPICS)
    return F.slice(F.array_distinct(F.filter(_edge_split(text, L.TRIM_TOPIC), lambda w: F.array_contains(known, w))), 1, 4)


def is_ordered_subsequence(inner: Column, outer: Column) -> Column:
    """All of ``inner`` occurs in ``outer`` in this order."""
    step = lambda k, w: k + F.when((k < F.size(inner)) & (F.get(inner, k) == w), 1).otherwise(0)
    return F.aggregate(outer, F.lit(0), step) == F.size(inner)


def has_polarity(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, _words(*L.POLARITY))


def subsumes(newer: Column, older: Column) -> Column:
    """'equivalent', 'new_subsumes_old', 'old_subsumes_new' or 'distinct', over token arrays.

    Texts of fewer than three tokens and texts of different polarity are distinct.
    """
    long = (F.size(newer) >= 3) & (F.size(older) >= 3) & (has_polarity(newer) == has_polarity(older))
    old_in_new = is_ordered_subsequence(older, newer)
    new_in_old = is_ordered_subsequence(newer, older)
    return (
        F.when(~long, "distinct")
        .when(F.array_join(newer, " ") == F.array_join(older, " "), "equivalent")
        .when(old_in_new, "new_subsumes_old")
        .when(new_in_old, "old_subsumes_new")
        .otherwise("distinct")
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tag_ratio(a: Column, b: Column) -> Column:
    """Share of common tags in the shorter list, letter case aside; repeats in ``b`` count."""
    low_a, low_b = F.transform(a, F.lower), F.transform(b, F.lower)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.filter(low_b, lambda t: F.array_contains(low_a, t))) / least).otherwise(F.lit(0.0))


def tags_union(a: Column, b: Column) -> Column:
    """First spellings in order, blanks dropped; null when nothing is left."""
    every = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda t: F.trim(t) != "")
    step = lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))
    out = F.aggregate(every, F.array().cast("array<string>"), step)
    return F.when(F.size(out) > 0, out)


def without_negation(text: Column) -> Column:
    drop = _words(*L.NEGATION_WORDS)
    return F.array_join(F.filter(F.split(F.lower(text), r"\s+"), lambda w: ~F.array_contains(drop, w)), " ")


def has_negation(text: Column) -> Column:
    return _has_any(F.lower(text), L.NEGATION_MARKS)


def triples(text: Column) -> Column:
    """Array of (verb, subject, object): for each verb at its first place, the last three meaningful words before and the first three after. Words of one byte say nothing."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    stop = _words(*L.SUBJECT_STOP)

    def one(verb: str) -> Column:
        mark = f" {verb} "
        at = F.instr(low, mark)
        words = lambda s: F.filter(F.transform(F.split(F.trim(s), r"\s+"), lambda w: F.btrim(w, F.lit(L.TRIM_SIGNIFICANT))), lambda w: F.octet_length(w) > 1)
        before = F.filter(words(F.substring(low, F.lit(1), at - 1)), lambda w: ~F.array_contains(stop, w))
        after = words(F.substring(low, at + len(mark), F.length(low)))
        subject = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3))
        made = F.struct(F.lit(verb).alias("verb"), F.array_join(subject, " ").alias("subject"), F.slice(after, 1, 3).alias("object"))
        return F.when((at > 0) & (F.size(before) > 0) & (F.size(after) > 0), made)

    return F.filter(F.array(*[one(v) for v in L.VERBS]), lambda t: t.isNotNull())


def refines(a: Column, b: Column) -> Column:
    """One word list is a prefix of the other."""
    short = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), short) == F.slice(b, F.lit(1), short)


def contradiction_features(text: Column, tags: Column) -> Column:
    """What the contradiction rules need of one memory; worked out once per memory, before memories are paired."""
    return F.struct(
        significant_words(text).alias("words"),
        significant_words(without_negation(text)).alias("plain"),
        triples(text).alias("triples"),
        has_negation(text).alias("denied"),
        F.get(F.filter(_words(*L.REPLACEMENT_MARKS), lambda m: F.lower(text).contains(m)), F.lit(0)).alias("replaces"),
        tags.alias("tags"),
    )


def contradiction(new: Column, old: Column) -> Column:
    """Struct (reason, confidence) of the first rule that holds between two feature structs, or null; the reason names the signal, or what is said of what."""
    overlap = jaccard(new["words"], old["words"])
    tags = tag_ratio(new["tags"], old["tags"])
    replaced = new["replaces"].isNotNull() & ((overlap >= 0.15) | (tags >= 0.3))
    other = lambda x, y: (x["verb"] == y["verb"]) & (x["subject"] == y["subject"]) & (x["object"] != y["object"]) & ~refines(x["object"], y["object"])
    said = lambda x, y: F.concat(x["subject"], F.lit(" "), x["verb"], F.lit(": "), F.array_join(x["object"], " "), F.lit(" vs "), F.array_join(y["object"], " "))
    clashes = F.flatten(F.transform(new["triples"], lambda x: F.transform(F.filter(old["triples"], lambda y: other(x, y)), lambda y: said(x, y))))
    clash = F.get(clashes, F.lit(0))
    plain = jaccard(new["plain"], old["plain"])
    denied = (plain >= 0.4) & (new["denied"] != old["denied"])
    vague = (F.size(new["tags"]) > 0) & (F.size(old["tags"]) > 0) & (tags >= 0.5) & (plain >= 0.3) & (plain < 0.8)
    made = lambda reason, c: F.struct(reason.alias("reason"), F.lit(c).alias("confidence"))
    return (
        F.when(replaced, made(F.concat(F.lit("replacement signal: "), new["replaces"]), 0.9))
        .when(clash.isNotNull(), made(clash, 0.85))
        .when(denied, made(F.lit("negation conflict with high similarity"), 0.8))
        .when(vague, made(F.lit("shared tags with divergent content"), 0.5))
    )


def lexical_relevance(text: Column, tags: Column, words: Column) -> Column:
    """Average over different words of 1 for a tag, 0.75 for a place in the text; 1 without words."""
    different = F.array_distinct(words)
    low, low_tags = F.lower(text), F.transform(tags, F.lower)
    value = lambda w: F.when(F.array_contains(low_tags, w), 1.0).when(low.contains(w), 0.75).otherwise(0.0)
    total = F.aggregate(different, F.lit(0.0), lambda s, w: s + value(w))
    return F.when(F.size(different) == 0, F.lit(1.0)).otherwise(total / F.size(different))


def rendered_turn(date: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("On "), date, F.lit(", "), speaker, F.lit(" said that "), F.regexp_replace(text, r"\n", " "))


def evidence_keys(text: Column) -> Column:
    """Different keys of the form D<session>:<turn>, leading zeros dropped."""
    found = F.regexp_extract_all(text, F.lit(r"D0*(\d+):0*(\d+)"), 0)
    return F.array_distinct(F.transform(found, lambda k: F.regexp_replace(k, r"D0*(\d+):0*(\d+)", "D$1:$2")))


def turn_key(conversation: Column, turn: Column) -> Column:
    return F.concat_ws("/", conversation, turn)


def without_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the text itself, trimmed."""
    inner = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n?(.*?)```", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(text), r"^\s+|\s+$", "")


def redacted_url(text: Column) -> Column:
    """User information and secret parameters of URLs replaced by REDACTED."""
    users = F.regexp_replace(text, r"(https?://)[^/@\s]+@", "$1REDACTED@")
    return F.regexp_replace(users, r"(?i)([?&](?:key|token|api_key|apikey|access_token|secret|password)=)[^&\s]+", "$1REDACTED")


def json_tags(tags: Column) -> Column:
    return F.to_json(F.coalesce(tags, F.array().cast("array<string>")))


def parsed_tags(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
