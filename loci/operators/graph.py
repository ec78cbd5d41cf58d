"""The memory graph: edges, neighbours, subgraphs, entities, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import lists as L
from loci.functions import text as X


def check_relationship(name: str) -> str:
    if name not in L.RELATIONSHIPS:
        raise ValueError(f"unknown relationship {name!r}; one of {', '.join(L.RELATIONSHIPS)}")
    return name


def valid_relationship(column: Column) -> Column:
    return F.coalesce(column.isin(L.RELATIONSHIPS), F.lit(False))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Each (from, to, relationship) once, the first written; unknown relationships and null ends left out, weights into [0, 1] (null counts as 1)."""
    ok = edges.where(valid_relationship(F.col("relationship")) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    first = ok.groupBy("from_id", "to_id", "relationship").agg(F.min(F.struct("created_at", "id", "weight")).alias("e"))
    weight = F.coalesce("e.weight", F.lit(1.0))
    weight = F.when(F.isnan(weight), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)))
    return first.select(F.col("e.id").alias("id"), "from_id", "to_id", "relationship", weight.alias("weight"), F.col("e.created_at").alias("created_at"))


def add_edges(new: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """The edge table after a batch: existing keys keep their first edge, rows with a missing end are skipped."""
    known = memories.select("id").distinct()
    batch = clean_edges(new)
    batch = batch.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    fresh = batch.join(edges, ["from_id", "to_id", "relationship"], "left_anti")
    return edges.unionByName(fresh.select(*edges.columns))


def connect(new: DataFrame, edges: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge table, effective edges): weights not above 0 become 1; the effective edge is the older one if there is one.

    A missing end is an error.
    """
    ends = new.select(F.col("from_id").alias("id")).unionAll(new.select(F.col("to_id").alias("id"))).distinct()
    missing = ends.join(memories.select("id").distinct(), "id", "left_anti").limit(5).collect()
    if missing:
        raise LookupError("no memory " + ", ".join(str(r[0]) for r in missing))
    new = new.withColumn("weight", F.when(F.col("weight").isNull() | (F.col("weight") <= 0), 1.0).otherwise(F.col("weight")))
    after = add_edges(new, edges, memories)
    keys = new.select("from_id", "to_id", "relationship").distinct()
    return after, after.join(keys, ["from_id", "to_id", "relationship"], "left_semi").select(*edges.columns)


def neighbours(centres: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """``(centre, id, distance)``: memories within ``depth`` hops over edges of either direction; the centre itself only by a self edge or a way back.

    Two directed joins per hop instead of one join on either end.
    """
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionAll(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))).distinct()
    seen = None
    front = centres.select(F.col("id").alias("centre"), "id").distinct()
    for d in range(1, depth + 1):
        found = front.join(both, front["id"] == both["a"]).select("centre", F.col("b").alias("id")).distinct()
        if seen is not None:
            found = found.join(seen, ["centre", "id"], "left_anti")
        hop = found.withColumn("distance", F.lit(d))
        seen = hop if seen is None else seen.unionByName(hop)
        front = found
    return seen


def subgraph(centres: DataFrame, edges: DataFrame, memories: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(neighbour memories, incident memory-to-memory edges) of each centre."""
    near = neighbours(centres, edges, depth)
    nodes = near.join(memories.select("id", "content", "type"), "id").select("centre", "id", "distance", "content", "type")
    return nodes, edges_around(centres, edges, memories)


def edges_around(centres: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """``(centre, id, from_id, to_id, relationship, weight)``: edges with a centre as an end and a memory as the other, each once."""
    c = centres.select(F.col("id").alias("centre")).distinct()
    known = memories.select("id").distinct()
    out = edges.join(c, edges["from_id"] == c["centre"]).join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    back = edges.join(c, edges["to_id"] == c["centre"]).join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    cols = ["centre", "id", "from_id", "to_id", "relationship", "weight"]
    return out.select(*cols).unionByName(back.select(*cols)).distinct()


def counts(memories: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(nodes, edges)``: memories and entities; edges and mentions."""
    n = memories.agg(F.count(F.lit(1)).alias("n")).unionAll(entities.agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("n")).unionAll(mentions.agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("edges"))
    return n.withColumn("edges", e.scalar())


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that no memory mentions."""
    return entities.join(mentions.select("normalized_name", "project_id").distinct(), ["normalized_name", "project_id"], "left_anti").select(*entities.columns)


def delete(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without the memories of ``ids(id)``: vectors, edges and mentions go with them, then entities left without mention. Unknown ids are no error."""
    gone = ids.select("id").distinct()
    anti = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti").select(*df.columns)
    out = dict(tables)
    out["memories"] = anti(tables["memories"], "id")
    out["embeddings"] = anti(tables["embeddings"], "memory_id")
    out["edges"] = anti(anti(tables["edges"], "from_id"), "to_id")
    out["mentions"] = anti(tables["mentions"], "memory_id")
    lost = tables["mentions"].join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_semi").select("normalized_name", "project_id").distinct()
    orphaned = lost.join(out["mentions"].select("normalized_name", "project_id").distinct(), ["normalized_name", "project_id"], "left_anti")
    out["entities"] = tables["entities"].join(orphaned, ["normalized_name", "project_id"], "left_anti").select(*tables["entities"].columns)
    return out


def link_entities(named: DataFrame, entities: DataFrame, mentions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) after linking ``named(id, project_id, entities)``, as of ``new_links``."""
    new, links = new_links(named, entities, mentions, now)
    return entities.unionByName(new), mentions.unionByName(links)


def new_links(named: DataFrame, entities: DataFrame, mentions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The (entities, mentions) that ``named(id, project_id, entities)`` adds.

    Names are deduplicated by normalised name within a project; existing entities and mentions stay
    as they are. Rows without project are left out.
    """
    rows = named.where(F.coalesce("project_id", F.lit("")) != "").select("id", "project_id", F.posexplode("entities").alias("pos", "name"))
    rows = rows.withColumn("normalized_name", X.normalize_entity(F.col("name"))).where("normalized_name <> ''")
    links = rows.select(F.col("id").alias("memory_id"), "normalized_name", "project_id").distinct()
    added = links.join(mentions, ["memory_id", "normalized_name", "project_id"], "left_anti").withColumns({"weight": F.lit(1.0), "created_at": now})
    first = rows.groupBy("normalized_name", "project_id").agg(F.min(F.struct("id", "pos", "name")).alias("f"))
    new = first.join(entities, ["normalized_name", "project_id"], "left_anti")
    made = F.sha2(F.concat_ws("|", "project_id", "normalized_name"), 256)
    new = new.select(F.substring(made, 1, 32).alias("id"), F.col("f.name").alias("name"), "normalized_name", "project_id")
    return new.select(*entities.columns), added.select(*mentions.columns)


def upsert_embeddings(new: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Vectors by memory, the new one in place of an old one; zero, NaN and wrongly sized vectors are refused."""
    from loci.functions import vector as V

    ok = new.where(V.is_usable(F.col("embedding"), dim))
    last = ok.groupBy("memory_id").agg(F.max(F.struct("created_at", "project_id", "embedding")).alias("e"))
    last = last.select("memory_id", F.col("e.project_id").alias("project_id"), F.col("e.embedding").alias("embedding"), F.col("e.created_at").alias("created_at"))
    kept = embeddings.join(last.select("memory_id"), "memory_id", "left_anti")
    return kept.select(*embeddings.columns).unionByName(last.select(*embeddings.columns))


def with_access(memories: DataFrame, access_log: DataFrame) -> DataFrame:
    """Memories with the log's reads added to their counts; the log is append-only, so counting needs no update in place."""
    reads = access_log.groupBy(F.col("memory_id").alias("id")).agg(F.count(F.lit(1)).alias("__reads"))
    joined = memories.join(reads, "id", "left")
    return joined.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("__reads", F.lit(0))).select(*memories.columns)


def update_content(changes: DataFrame, memories: DataFrame) -> DataFrame:
    """Compare-and-swap: ``changes(id, expected_hash, new_content)`` take effect where the content's hash is as expected.

    A malformed hash is an error. Of several changes of one id the smallest new content counts.
    """
    if not changes.where(~X.is_content_hash(F.col("expected_hash"))).isEmpty():
        raise ValueError("expected_hash must be 32 hexadecimal digits")
    one = changes.groupBy(F.col("id").alias("__id"), F.col("expected_hash").alias("__hash")).agg(F.min("new_content").alias("__new"))
    rows = memories.withColumn("__now", X.content_hash(F.col("content")))
    joined = rows.join(one, (F.col("id") == F.col("__id")) & (F.col("__now") == F.col("__hash")), "left")
    changed = F.col("__new").isNotNull()
    return joined.withColumns(
        {"content_hash": F.when(changed, X.content_hash(F.col("__new"))).otherwise(F.col("content_hash")), "content": F.coalesce("__new", "content")}
    ).select(*memories.columns)
