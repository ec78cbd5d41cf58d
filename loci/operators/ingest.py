"""Consolidation on write: restatements, supersession and links of new memories, set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.functions import text as X
from loci.operators.retrieve import vector_pool
from loci.runtime import stored

# Fixed values.
SUPERSEDE_CANDIDATES, LINK_CANDIDATES, MOST_SUPERSEDES, MOST_LINKS = 50, 10, 5, 5
TAG_WEIGHT, FLOOR_NEIGHBOURS, FLOOR_SIGMAS, LEAST_CONFIDENCE = 0.5, 3, 1.0, 0.5


def newest(memories: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` newest rows of each project. The rank limit is applied before the shuffle, so a hot project moves ``n`` rows a task."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    return memories.select("id", "project_id", "created_at", *columns).withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def contradictions(new: DataFrame, memories: DataFrame, candidates: int = SUPERSEDE_CANDIDATES) -> DataFrame:
    """``(new_id, old_id, reason, confidence)``: semantic memories of a project against its newest semantic ones.

    ``candidates`` newest of a project are compared, as the write path does; that is its rule, not a cap of this engine.
    """
    recent = newest(memories.where("type = 'semantic' and content is not null"), candidates, "content", "tags")
    features = lambda name: X.contradiction_features(F.col("content"), F.col("tags")).alias(name)
    # Stored between: else the optimizer would move the features behind the join and work them out per pair.
    old = stored(recent.select(F.col("id").alias("old_id"), "project_id", features("old")), "old")
    fresh = stored(new.where("type = 'semantic' and content is not null").select(F.col("id").alias("new_id"), "project_id", features("new")), "fresh")
    pairs = fresh.join(old, "project_id").where("new_id <> old_id")
    found = pairs.select("new_id", "old_id", X.contradiction(F.col("new"), F.col("old")).alias("c"))
    return found.where(F.col("c.confidence") >= LEAST_CONFIDENCE).select("new_id", "old_id", "c.reason", "c.confidence")


def supersessions(found: DataFrame, most: int = MOST_SUPERSEDES) -> DataFrame:
    """The ``most`` surest contradictions of each new memory, as edges ``(from_id, to_id, relationship, weight)``."""
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("confidence"), "old_id"))
    kept = found.withColumn("n", rank).where(F.col("n") <= most)
    return kept.select(F.col("new_id").alias("from_id"), F.col("old_id").alias("to_id"), F.lit("supersedes").alias("relationship"), F.col("confidence").alias("weight"))


def vector_neighbours(new: DataFrame, embeddings: DataFrame, dim: int, most: int = LINK_CANDIDATES) -> DataFrame:
    """``(new_id, other_id, similarity)``: the ``most`` nearest vectors of the project, itself left out.

    The new rows are a stated query set: their vectors meet the stored ones in blocks, by matrix
    products, and the stored ones do not move. A row without project has no neighbours.
    """
    known = embeddings.select("memory_id", "project_id", "embedding")
    asked = new.where("project_id is not null").select(F.col("id").alias("query_id")).join(known.select(F.col("memory_id").alias("query_id"), "project_id", "embedding"), "query_id")
    near = vector_pool(asked.where("project_id is not null"), known, most + 1, dim).where("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return near.withColumn("n", rank).where(F.col("n") <= most).select(F.col("query_id").alias("new_id"), F.col("id").alias("other_id"), F.col("cosine").alias("similarity"))


def autolinks(new: DataFrame, memories: DataFrame, near: DataFrame, superseded: DataFrame | None = None, most: int = MOST_LINKS) -> DataFrame:
    """relates_to edges of new memories: a common tag with one of the project's newest, or a similarity on or above the floor of its neighbours.

    The floor is the mean of the similarities plus one population deviation, or the mean with fewer
    than three neighbours. A pair found both ways has the greater weight. Superseded ones are left
    out before, so they do not count in the floor either.
    """
    if superseded is not None:
        gone = superseded.select(F.col("from_id").alias("new_id"), F.col("to_id").alias("other_id")).distinct()
        near = near.join(gone, ["new_id", "other_id"], "left_anti")
    recent = newest(memories, LINK_CANDIDATES, "tags").select(F.col("id").alias("other_id"), "project_id", F.col("tags").alias("their"))
    fresh = new.select(F.col("id").alias("new_id"), "project_id", F.col("tags").alias("mine"))
    lower = lambda c: F.transform(c, F.lower)
    tagged = fresh.join(recent, "project_id").where("new_id <> other_id").where(F.arrays_overlap(lower(F.col("mine")), lower(F.col("their"))))
    by_tag = tagged.select("new_id", "other_id", F.lit(TAG_WEIGHT).alias("weight"))
    stats = near.groupBy("new_id").agg(F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("sd"), F.count(F.lit(1)).alias("n"))
    floor = F.when(F.col("n") >= FLOOR_NEIGHBOURS, F.col("mean") + FLOOR_SIGMAS * F.col("sd")).otherwise(F.col("mean"))
    by_vector = near.join(stats.select("new_id", floor.alias("floor")), "new_id").where(F.round("similarity", 9) >= F.round("floor", 9)).select("new_id", "other_id", F.col("similarity").alias("weight"))
    both = by_tag.unionByName(by_vector).groupBy("new_id", "other_id").agg(F.max("weight").alias("weight"))
    if superseded is not None:
        both = both.join(gone, ["new_id", "other_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc(F.round("weight", 9)), "other_id"))
    kept = both.withColumn("n", rank).where(F.col("n") <= most)
    return kept.select(F.col("new_id").alias("from_id"), F.col("other_id").alias("to_id"), F.lit("relates_to").alias("relationship"), "weight")


def folds(new: DataFrame, memories: DataFrame, near: DataFrame) -> DataFrame:
    """``(new_id, old_id, verdict)``: the first of a new memory's neighbours, most similar first, of its type and not distinct from it."""
    old = memories.select(F.col("id").alias("old_id"), F.col("content").alias("old"), F.col("type").alias("old_type"))
    pairs = near.select("new_id", F.col("other_id").alias("old_id"), "similarity").join(old, "old_id")
    pairs = pairs.join(new.select(F.col("id").alias("new_id"), F.col("content").alias("new"), "type"), "new_id").where("type = old_type")
    verdict = X.subsumes(X.content_tokens(F.col("new")), X.content_tokens(F.col("old")))
    judged = pairs.withColumn("verdict", verdict).where("verdict <> 'distinct'")
    rank = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc(F.round("similarity", 9)), "old_id"))
    return judged.withColumn("n", rank).where("n = 1").select("new_id", "old_id", "verdict")


def changes(new: DataFrame, memories: DataFrame, embeddings: DataFrame, dim: int, now: Column, fold: bool = True) -> dict[str, DataFrame]:
    """What a batch of new memories changes: ``memories`` (added and updated rows), ``embeddings`` and ``edges`` (added), ``folded`` (new_id, old_id, verdict).

    ``new`` has the columns of memories and an ``embedding``. Set mode: every new row is judged
    against the stored rows of its project, not against other rows of the batch (fold a batch with
    ``extract.fold_redundant`` first). Exact restatements and folded rows add no memory but an
    access. ``memories`` and ``embeddings`` need hold no more than the projects of the batch.
    """
    from loci.operators.graph import clean_edges
    from loci.operators.memories import duplicates_by_hash

    # What has the size of the batch is written once; the tables themselves are only read.
    judged = stored(duplicates_by_hash(new, memories), "judged")
    again = judged.where("existing_id is not null").select(F.col("id").alias("new_id"), F.col("existing_id").alias("old_id"), F.lit("equivalent").alias("verdict"))
    fresh = judged.where("existing_id is null").drop("existing_id")
    own = fresh.where("embedding is not null").select(F.col("id").alias("memory_id"), "project_id", "embedding", now.alias("created_at")).select(*embeddings.columns)
    vectors = embeddings.unionByName(own)
    if fold:
        near_old = vector_neighbours(fresh.select("id", "project_id"), vectors, dim).join(memories.select(F.col("id").alias("other_id")), "other_id", "left_semi")
        again = again.unionByName(folds(fresh, memories, near_old))
    again = stored(again, "again")
    kept = stored(fresh.join(again.select(F.col("new_id").alias("id")), "id", "left_anti"), "kept")
    upgraded = again.where("verdict = 'new_subsumes_old'").join(new.select(F.col("id").alias("new_id"), "content"), "new_id").groupBy(F.col("old_id").alias("id")).agg(F.min("content").alias("__better"))
    reads = again.groupBy(F.col("old_id").alias("id")).agg(F.count(F.lit(1)).alias("__reads"))
    touched = memories.join(reads, "id").join(upgraded, "id", "left")
    touched = touched.withColumns(
        {
            "content_hash": F.when(F.col("__better").isNotNull(), X.content_hash(F.col("__better"))).otherwise(F.col("content_hash")),
            "content": F.coalesce("__better", "content"),
            "access_count": F.coalesce("access_count", F.lit(0)) + F.col("__reads"),
        }
    ).select(*memories.columns)
    touched = stored(touched, "touched")
    changed = touched.unionByName(kept.select(*memories.columns))
    after = memories.join(touched.select("id"), "id", "left_anti").select(*memories.columns).unionByName(changed)
    supers = stored(supersessions(contradictions(kept, after)), "supers")
    near = stored(vector_neighbours(kept.select("id", "project_id"), vectors, dim), "near")
    near = near.join(after.select(F.col("id").alias("other_id")), "other_id", "left_semi")
    links = autolinks(kept, after, near, supers)
    made = supers.unionByName(links).withColumns({"id": F.sha1(F.concat_ws("|", "from_id", "to_id", "relationship")), "created_at": now})
    ids = kept.select(F.col("id").alias("memory_id"))
    return {"memories": changed, "edges": stored(clean_edges(made), "made"), "folded": again, "embeddings": own.join(ids, "memory_id", "left_semi").select(*embeddings.columns)}


def store(new: DataFrame, memories: DataFrame, embeddings: DataFrame, edges: DataFrame, dim: int, now: Column, fold: bool = True) -> dict[str, DataFrame]:
    """The tables after a batch: ``memories``, ``edges``, ``embeddings``, and ``folded``, as of ``changes``."""
    from loci.operators.graph import add_edges

    made = changes(new, memories, embeddings, dim, now, fold)
    after = memories.join(made["memories"].select("id"), "id", "left_anti").select(*memories.columns).unionByName(made["memories"])
    return {
        "memories": after, "edges": add_edges(made["edges"].select(*edges.columns), edges, after), "folded": made["folded"],
        "embeddings": embeddings.unionByName(made["embeddings"]),
    }
