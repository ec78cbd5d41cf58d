"""Reading memories: rows delivered again, dirty fields, filters and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import lists as L
from loci.functions import text as X


def latest(df: DataFrame, key: str | Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the greatest ``order``; null keys take no part.

    A combinable aggregate (no window), so a key that was delivered often moves one row per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    named = df.where(F.col(keys[0]).isNotNull())
    best = named.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def current(memories: DataFrame) -> DataFrame:
    """Each memory once, cleaned as on read.

    Of rows delivered again the one with the most accesses counts. Types are trimmed and in lower
    case, unknown ones null; null tags are no tags; a decay of null, 0 or NaN reads as 1.
    """
    one = latest(memories, "id", F.coalesce("access_count", F.lit(-1).cast("bigint")))
    kind = F.lower(F.trim("type"))
    decay = F.col("decay_score")
    return one.withColumns(
        {
            "type": F.when(kind.isin(L.MEMORY_TYPES), kind),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "access_count": F.coalesce("access_count", F.lit(0).cast("bigint")),
            "decay_score": F.when(decay.isNull() | F.isnan(decay) | (decay == 0), 1.0).otherwise(decay),
        }
    )


def by_id(memories: DataFrame, ident: str) -> DataFrame:
    """The memory with this id; an unknown id is an error when the result is read."""
    found = memories.where(F.col("id") == ident)
    if found.isEmpty():
        raise LookupError(f"no memory {ident}")
    return found


def in_project(df: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of a project; null or '' means all."""
    return df.where(F.col("project_id") == project_id) if project_id else df


def of_types(df: DataFrame, types: Sequence[str] | None) -> DataFrame:
    known = [t for t in types or [] if t in L.MEMORY_TYPES]
    return df.where(F.col("type").isin(known)) if known else df


def match_count(words: Sequence[str]) -> Column:
    """How many of the words are in the content or the tags' JSON text, letter case aside."""
    text, tags = F.lower(F.coalesce("content", F.lit(""))), F.lower(X.json_tags(F.col("tags")))
    out = F.lit(0)
    for w in words:
        out = out + F.when(text.contains(w.lower()) | tags.contains(w.lower()), 1).otherwise(0)
    return out


def listing(memories: DataFrame, project_id: str | None = None, types: Sequence[str] | None = None, words: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Memories that hold any of the words, most matches first, then newest, then by id."""
    rows = of_types(in_project(memories, project_id), types)
    if words:
        rows = rows.withColumn("matches", match_count(words)).where("matches > 0")
    else:
        rows = rows.withColumn("matches", F.lit(0))
    ordered = rows.orderBy(F.desc("matches"), F.desc("created_at"), "id")
    return ordered.limit(limit) if limit else ordered


def duplicates_by_hash(incoming: DataFrame, memories: DataFrame) -> DataFrame:
    """Incoming rows with ``existing_id``: the smallest id of a memory of the same project, hash and type, or null."""
    stored = (
        memories.withColumn("__hash", X.content_hash(F.col("content")))
        .where(F.col("__hash") != "")
        .groupBy("project_id", "__hash", "type")
        .agg(F.min("id").alias("existing_id"))
    )
    fresh = incoming.withColumn("__hash", X.content_hash(F.col("content")))
    return fresh.join(stored, ["project_id", "__hash", "type"], "left").drop("__hash").select(*incoming.columns, "existing_id")
