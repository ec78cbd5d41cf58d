"""Typed facts out of recalled sentences, and structured answers of extraction models, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loci.functions import lists as L
from loci.functions import text as X

_DAY = r"(\d{4}-\d{2}-\d{2})"
#: kind -> pattern of a dated note; the first group is its day. Order does not matter: no sentence fits two.
NOTES = {
    "contact": rf"^{_DAY}: [\w -]+ went to .+ about INV-",
    "promise": rf"^{_DAY}: .+ will pay INV-\S+ by \d{{4}}-\d{{2}}-\d{{2}}\.$",
    "payment": rf"^{_DAY}: .+ paid INV-\S+ in full",
    "dispute": rf"^{_DAY}: .+ disputes INV-",
    "no_response": rf"^{_DAY}: .+ has not answered about INV-",
    "escalation": rf"^{_DAY}: INV-\S+ of .+ was handed to a human",
}
# Fixed values.
DISPUTE_WORDS = ["dispute", "disputing", "incorrect", "wrong"]
_LLM = "array<struct<content string, type string, tags array<string>, entities array<string>>>"


def note_kind(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in NOTES.items():
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def note_day(text: Column) -> Column:
    return F.when(note_kind(text).isNotNull(), F.substring(text, 1, 10).try_cast("date"))


def note_invoice(text: Column) -> Column:
    return F.when(note_kind(text).isNotNull(), F.regexp_extract(text, r"INV-\d{4}-\d+", 0))


def note_amount(text: Column) -> Column:
    """The amount in a note's brackets, without thousands separators; null without one."""
    digits = F.regexp_replace(F.regexp_extract(text, r"\(\D{0,3}([\d,]+)\)", 1), ",", "")
    return F.when(note_kind(text).isNotNull() & (digits != ""), digits.try_cast("bigint"))


def reply_date(text: Column) -> Column:
    """The first ISO date in a reply, or null."""
    return F.regexp_extract(text, r"\b\d{4}-\d{2}-\d{2}\b", 0).try_cast("date")


def is_dispute(text: Column) -> Column:
    return F.lower(text).rlike(r"\b(" + "|".join(DISPUTE_WORDS) + r")\b")


def parsed_memories(text: Column) -> Column:
    """Memories in a model's answer: a JSON array, in a Markdown fence or not.

    Types are in lower case, unknown ones semantic; blank contents are dropped; null lists become
    empty. An answer that is no such array is null, and the caller falls back to the rules.
    """
    rows = F.from_json(X.without_fence(text), _LLM)
    none = F.array().cast("array<string>")
    kept = F.filter(rows, lambda r: F.trim(F.coalesce(r["content"], F.lit(""))) != "")
    kind = lambda r: F.lower(F.trim(r["type"]))
    return F.transform(
        kept,
        lambda r: F.struct(
            r["content"].alias("content"), F.when(kind(r).isin(L.MEMORY_TYPES), kind(r)).otherwise(F.lit("semantic")).alias("type"),
            F.coalesce(r["tags"], none).alias("tags"), F.coalesce(r["entities"], none).alias("entities"),
        ),
    )


def answer_text(json: Column) -> Column:
    """The answer of a question: its string, or the raw JSON text of anything else."""
    return F.get_json_object(json, "$.answer")
