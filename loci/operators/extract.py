"""Memories out of conversations by rules, and folding of what says the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.functions import lists as L
from loci.functions import text as X
from loci.functions.entities import find_entities

_POLARITY = frozenset(L.POLARITY)


def rule_extract(conversations: DataFrame) -> DataFrame:
    """``(conversation_id, seq, content, type, tags)`` of ``conversations(conversation_id, text)``.

    Line by line: speaker labels are dropped, lines under ten bytes and noise left out, the rest
    classified; tags are the topics and the rule's tag. A content repeated in one conversation,
    letter case aside, counts once, at its first place. Null texts give nothing.
    """
    lines = conversations.select("conversation_id", F.posexplode(X.utterances(F.col("text"))).alias("seq", "line"))
    lines = lines.where(F.octet_length("line") >= 10).select("conversation_id", "seq", F.trim(X.strip_speaker(F.col("line"))).alias("content"))
    typed = lines.withColumn("c", X.classified(F.col("content"))).where("c.type is not null")
    tags = F.concat(X.topics(F.col("content")), F.when(F.col("c.tag").isNotNull(), F.array("c.tag")).otherwise(F.array().cast("array<string>")))
    rows = typed.select("conversation_id", "seq", "content", F.col("c.type").alias("type"), tags.alias("tags"))
    first = rows.groupBy("conversation_id", F.lower("content").alias("k")).agg(F.min_by(F.struct("seq", "content", "type", "tags"), "seq").alias("r"))
    return first.select("conversation_id", "r.*")


def verdict(newer: list[str], older: list[str]) -> str:
    """As ``functions.text.subsumes``, on token lists of one task."""
    if len(newer) < 3 or len(older) < 3 or (not _POLARITY.isdisjoint(newer)) != (not _POLARITY.isdisjoint(older)):
        return "distinct"
    if newer == older:
        return "equivalent"

    def inside(a: list[str], b: list[str]) -> bool:
        rest = iter(b)
        return all(w in rest for w in a)

    return "new_subsumes_old" if inside(older, newer) else "old_subsumes_new" if inside(newer, older) else "distinct"


def _tokens(text: str) -> list[str]:
    return [w for w in (x.strip(L.TRIM_TOKEN) for x in text.lower().split()) if w]


def _union_tags(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    out: dict[str, str] = {}
    for t in [*(a or []), *(b or [])]:
        if t and t.strip():
            out.setdefault(t.lower(), t)
    return list(out.values()) or None


def _fold(table: pa.Table) -> pa.Table:
    kept: list[dict] = []
    for row in sorted(table.to_pylist(), key=lambda r: r["seq"]):
        words = _tokens(row["content"])
        for k in kept:
            if k["type"] != row["type"]:
                continue
            v = verdict(words, k["words"])
            if v == "distinct":
                continue
            k["tags"] = _union_tags(k["tags"], row["tags"])
            k["folded"] += 1
            if v == "new_subsumes_old":
                k["content"], k["words"] = row["content"], words
            break
        else:
            kept.append({**row, "words": words, "folded": 0})
    fields = ("conversation_id", "seq", "content", "type", "tags", "folded")
    schema = pa.schema([table.schema.field(f) for f in fields[:-1]] + [pa.field("folded", pa.int64())])
    return pa.Table.from_pylist([{f: k[f] for f in fields} for k in kept], schema=schema)


def fold_redundant(extracted: DataFrame) -> DataFrame:
    """Extracted rows with later restatements folded into earlier ones: ``folded`` counts them.

    Order decides, so a conversation is replayed row by row in one task; a conversation is a
    bounded exchange, not a key that grows with the collection.
    """
    kind = extracted.schema["conversation_id"].dataType.simpleString()
    rows = extracted.select("conversation_id", "seq", "content", "type", "tags")
    return rows.groupBy("conversation_id").applyInArrow(_fold, f"conversation_id {kind}, seq int, content string, type string, tags array<string>, folded bigint")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [find_entities(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.list_(pa.string()))], names=["id", "entities"])


def memory_entities(memories: DataFrame) -> DataFrame:
    """``(id, entities)`` of ``memories(id, content)``."""
    kind = memories.schema["id"].dataType.simpleString()
    return memories.select("id", "content").mapInArrow(_named, f"id {kind}, entities array<string>")


def to_memories(extracted: DataFrame, project_id: str, now) -> DataFrame:
    """Rows of ``schema.MEMORIES`` with ids that follow from conversation, place and content."""
    made = F.sha1(F.concat_ws("|", F.col("conversation_id").cast("string"), F.col("seq").cast("string"), "content"))
    part = lambda a, n: F.substring(made, a, n)
    ident = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12))
    return extracted.select(
        ident.alias("id"), "content", "type", F.lit(project_id).alias("project_id"), "tags", now.alias("created_at"), F.lit(0).cast("bigint").alias("access_count"),
        F.lit(1.0).alias("decay_score"), X.content_hash(F.col("content")).alias("content_hash"),
    )


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
