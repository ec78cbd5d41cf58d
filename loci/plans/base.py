"""What the query modules share: tables, the clock, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.functions import vector as V
from loci.operators import graph, memories, retrieve
from loci.runtime import stored, table

#: The clock of every query and its SQL.
NOW = "2026-10-01 00:00:00"
DIM = 64


class Tables:
    """The test tables of one folder, cleaned as on read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.now = F.lit(NOW).cast("timestamp")

    def raw(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.path, name, *columns)

    @cached_property
    def memories(self) -> DataFrame:
        return memories.current(self.raw("memories"))

    @cached_property
    def kept(self) -> DataFrame:
        """The cleaned memories, written once, for queries that read them many times."""
        return stored(self.memories, "kept")

    @cached_property
    def index(self) -> DataFrame:
        """Postings, written once."""
        return stored(retrieve.postings(self.kept), "postings")

    @cached_property
    def embeddings(self) -> DataFrame:
        """Usable vectors, each memory once."""
        ok = self.raw("memory_embeddings").where(V.is_usable(F.col("embedding"), DIM))
        return ok.groupBy("memory_id").agg(F.max_by(F.struct("project_id", "embedding"), F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp"))).alias("r")).select("memory_id", "r.project_id", "r.embedding")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.clean_edges(self.raw("edges"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.raw("mentions").select("memory_id", "normalized_name", "project_id").distinct()

    @cached_property
    def entities(self) -> DataFrame:
        return self.raw("entities")

    @cached_property
    def asked(self) -> DataFrame:
        """All questions of the held-out items, over all projects; and one per project: its smallest memory id that has words and a vector is asked for again."""
        both = self.kept.where("content is not null and project_id is not null").join(self.embeddings.select(F.col("memory_id").alias("id"), "embedding"), "id")
        first = both.groupBy("project_id").agg(F.min_by(F.struct("id", "content", "embedding"), "id").alias("r"))
        names = self.mentions.groupBy(F.col("memory_id").alias("mid"), "project_id").agg(F.collect_set("normalized_name").alias("entities"))
        one = first.select(F.col("project_id").alias("query_id"), "project_id", F.col("r.id").alias("mid"), F.col("r.content").alias("text"), "r.embedding")
        full = one.join(names, ["mid", "project_id"], "left").select("query_id", "project_id", "mid", "text", "embedding", "entities")
        items = self.raw("eval_items", "item_id", "question").where("item_id is not null and question is not null").select(F.concat(F.lit("item-"), "item_id").alias("query_id"), F.col("question").alias("text"))
        return stored(full.unionByName(items, allowMissingColumns=True), "asked")

    @cached_property
    def questions(self) -> DataFrame:
        """The questions of the held-out items, over all projects."""
        q = self.raw("eval_items", "item_id", "question")
        return q.select(F.col("item_id").cast("string").alias("query_id"), F.lit(None).cast("string").alias("project_id"), F.col("question").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name, with its SQL if there is one."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, path: f(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# --- SQL pieces -------------------------------------------------------------------------------


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_split(column: str, trim: str) -> str:
    chars = trim.replace("'", "''")
    return f"list_transform(regexp_split_to_array(lower({column}), '\\s+'), lambda w: trim(w, '{chars}'))"


def sql_tokens(column: str) -> str:
    from loci.functions.lists import TRIM_TOKEN

    return f"list_filter({sql_split(column, TRIM_TOKEN)}, lambda w: w <> '')"


def sql_keywords(column: str) -> str:
    from loci.functions.lists import KEYWORD_STOP, TRIM_KEYWORD

    return f"list_filter({sql_split(column, TRIM_KEYWORD)}, lambda w: strlen(w) >= 2 AND w NOT IN ({quoted(KEYWORD_STOP)}))"


SQL_NOW = f"TIMESTAMPTZ '{NOW}+00'"

MEM = """
mem AS (
  SELECT id, r.content AS content, CASE WHEN lower(trim(r.type)) IN ('episodic', 'semantic', 'procedural') THEN lower(trim(r.type)) END AS type,
    r.project_id AS project_id, coalesce(r.tags, []::VARCHAR[]) AS tags, r.created_at AS created_at, coalesce(r.access_count, 0) AS access_count,
    CASE WHEN r.decay_score IS NULL OR isnan(r.decay_score) OR r.decay_score = 0 THEN 1.0 ELSE r.decay_score END AS decay_score, r.content_hash AS content_hash
  FROM (
    SELECT id, arg_max({'content': content, 'type': type, 'project_id': project_id, 'tags': tags, 'created_at': created_at, 'access_count': access_count,
      'decay_score': decay_score, 'content_hash': content_hash}, coalesce(access_count, -1)) AS r
    FROM memories WHERE id IS NOT NULL GROUP BY id))"""

EMB = f"""
emb AS (
  SELECT memory_id, arg_max(project_id, created_at) AS project_id, arg_max(embedding, created_at) AS embedding FROM memory_embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY memory_id)"""

EDG = """
edg AS (
  SELECT r.id AS id, from_id, to_id, relationship, CASE WHEN isnan(coalesce(r.weight, 1.0)) THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce(r.weight, 1.0))) END AS weight, r.created_at AS created_at
  FROM (
    SELECT from_id, to_id, relationship, arg_min({'id': id, 'weight': weight, 'created_at': created_at}, (created_at, id)) AS r FROM edges
    WHERE relationship IN ('belongs_to', 'contains', 'relates_to', 'supersedes', 'caused_by', 'mentions') AND from_id IS NOT NULL AND to_id IS NOT NULL
    GROUP BY 1, 2, 3))"""

MEN = "men AS (SELECT DISTINCT memory_id, normalized_name, project_id FROM mentions)"

ASKED = """
both_ AS (SELECT mem.id, mem.content, mem.project_id, emb.embedding FROM mem JOIN emb ON mem.id = emb.memory_id WHERE mem.content IS NOT NULL AND mem.project_id IS NOT NULL),
asked AS (SELECT project_id AS query_id, project_id, min(id) AS mid, arg_min(content, id) AS text, arg_min(embedding, id) AS embedding FROM both_ GROUP BY project_id
  UNION ALL SELECT 'item-' || item_id::VARCHAR, NULL, NULL, question, NULL FROM eval_items WHERE item_id IS NOT NULL AND question IS NOT NULL)"""

COSINE = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def posted(name: str = "posted") -> str:
    """Postings over content and tags."""
    return f"""
words_ AS (SELECT id, project_id, unnest(list_concat({sql_tokens("coalesce(content, '')")}, {sql_tokens("array_to_string(tags, ' ')")})) AS token FROM mem),
{name} AS (SELECT token, id, project_id, count(*) AS tf FROM words_ GROUP BY 1, 2, 3)"""
