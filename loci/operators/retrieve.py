"""Hybrid retrieval for whole tables of queries: keyword, vector and entity pools, fused and scored.

Everything is set-based: one plan answers all queries. Pools are long rows
``(query_id, id, ...)``; only ids and scores travel until the last join fetches the memories.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.config import EngineConfig, pools
from loci.functions import scoring as S
from loci.functions import text as X
from loci.functions import vector as V
from loci.runtime import stored


#: Queries whose vectors are broadcast at once, and bytes of vectors a task holds before it prunes them.
QUERY_BLOCK, HELD_BYTES = 10_000, 64_000_000


def postings(memories: DataFrame) -> DataFrame:
    """``(token, id, project_id, tf)``: words of content and tags with their count per memory."""
    words = F.concat(X.content_tokens(F.coalesce("content", F.lit(""))), X.content_tokens(F.concat_ws(" ", "tags")))
    return memories.select("id", "project_id", F.explode(words).alias("token")).groupBy("id", "project_id", "token").agg(F.count(F.lit(1)).alias("tf")).select("token", "id", "project_id", "tf")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, project_id, term, times)``: the keywords of each query, repeated ones counted."""
    words = queries.select("query_id", "project_id", F.explode(X.keywords(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "project_id", "term").agg(F.count(F.lit(1)).alias("times"))


def small(df: DataFrame, bound: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``bound`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= bound else df


def corpus_sizes(memories: DataFrame) -> DataFrame:
    """``(project_id, n)``: memories in each scope; the null project stands for all."""
    per = memories.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    every = memories.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("project_id"), "n")
    return per.unionByName(every)


def term_weights(terms: DataFrame, posted: DataFrame, memories: DataFrame) -> DataFrame:
    """``(query_id, project_id, term, times, df, n, idf)``; document frequency and corpus size are at least 1."""
    asked = terms.select("project_id", "term").distinct()
    scoped = asked.where("project_id is not null").join(posted.select("project_id", F.col("token").alias("term"), "id"), ["project_id", "term"])
    free = asked.where("project_id is null").select("term").join(posted.select(F.col("token").alias("term"), "id"), "term").select(F.lit(None).cast("string").alias("project_id"), "term", "id")
    # Postings hold an id once per token, so counting rows counts memories.
    counts = scoped.unionByName(free).groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    t, c, n = terms.alias("t"), counts.alias("c"), corpus_sizes(memories).alias("n")
    joined = t.join(c, F.col("t.project_id").eqNullSafe(F.col("c.project_id")) & (F.col("t.term") == F.col("c.term")), "left").join(
        n, F.col("t.project_id").eqNullSafe(F.col("n.project_id")), "left"
    )
    df = F.greatest(F.coalesce("c.df", F.lit(0)), F.lit(1))
    size = F.greatest(F.coalesce("n.n", F.lit(0)), F.lit(1))
    return joined.select("t.query_id", "t.project_id", "t.term", "t.times", df.alias("df"), size.alias("n"), S.idf(size, df).alias("idf"))


def keyword_pool(terms: DataFrame, weights: DataFrame, posted: DataFrame, pool: Column) -> DataFrame:
    """``(query_id, id, kw_raw, kw_rank)``: the ``pool`` best memories of each query by the sum of idf times 0.1 per match."""
    w = weights.select("query_id", "project_id", F.col("term").alias("token"), "times", "idf")
    # Scoped terms meet the postings of their project only; a filter after a join on the token alone would meet all.
    scoped = posted.join(w.where("project_id is not null"), ["project_id", "token"]).select("query_id", "id", "times", "idf", "tf")
    free = posted.drop("project_id").join(w.where("project_id is null").drop("project_id"), "token").select("query_id", "id", "times", "idf", "tf")
    raw = scoped.unionByName(free).groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("idf") * S.RANK_PER_TERM * F.col("tf")).alias("kw_raw"))
    raw = raw.where("kw_raw > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("kw_raw", 9)), "id"))
    return raw.withColumn("kw_rank", rank).where(F.col("kw_rank") <= pool)


def idf_sums(weights: DataFrame) -> DataFrame:
    """``(query_id, idf_sum, terms)``: over all keywords, unmatched and repeated ones included."""
    return weights.groupBy("query_id").agg(F.sum(F.col("times") * F.col("idf")).alias("idf_sum"), F.sum("times").alias("terms"))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _best_in_batch(batches: Iterator[pa.RecordBatch], shared, dim: int, pool: int) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors the rows that can be among the ``pool`` nearest of a query, by matrix products.

    Batches are gathered up to a bound first, so that small projects are pruned as well.
    """
    names, unit, scopes = shared.value
    names = pa.array(names, pa.string())

    def gathered() -> Iterator[pa.Table]:
        held, rows = [], 0
        for b in batches:
            if None not in scopes and b.num_rows:
                b = b.filter(pc.is_in(b.column(1), pa.array([s for s in scopes if s is not None], pa.string())))
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows * dim * 8 > HELD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    for batch in gathered():
        vectors = _unit(batch.column(2).combine_chunks(), dim)
        places: dict[str, list[int]] = {}
        for i, place in enumerate(batch.column(1).to_pylist()):
            if place is not None and place in scopes:
                places.setdefault(place, []).append(i)
        groups = [(np.array(rows), scopes[place]) for place, rows in places.items()]
        if None in scopes:
            groups.append((np.arange(batch.num_rows), scopes[None]))
        ids = batch.column(0).combine_chunks()
        for rows, every in groups:
            # In slices of queries, so that the products stay bounded.
            step = max(1, 4_000_000 // rows.size)
            for lo in range(0, every.size, step):
                asked = every[lo : lo + step]
                cos = unit[asked] @ vectors[rows].T
                if rows.size > pool:
                    # Everything that ties with the last of the pool goes on; the final rank is by rounded cosine and id.
                    last = np.partition(cos, rows.size - pool, axis=1)[:, rows.size - pool]
                    q, r = np.nonzero(cos >= last[:, None] - 2e-9)
                else:
                    q, r = (x.ravel() for x in np.indices(cos.shape))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(asked[q])), ids.take(pa.array(rows[r])), pa.array(cos[q, r])], names=["query_id", "id", "cosine"])


def vector_pool(queries: DataFrame, embeddings: DataFrame, pool: int, dim: int) -> DataFrame:
    """``(query_id, id, cosine, vec_rank)``: the ``pool`` nearest vectors of each query, exact, in its project if it names one.

    ``queries`` is ``(query_id, project_id, embedding)``: a stated query set that meets the vectors
    in counted blocks of about ``QUERY_BLOCK`` queries, each broadcast. The vectors never move; of
    each batch only what can be in a pool goes to the final rank.
    """
    ok = V.is_usable(F.col("embedding"), dim)
    known = embeddings.where(ok).select(F.col("memory_id").alias("id"), F.col("project_id").alias("place"), F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.where(ok).select("query_id", "project_id", F.col("embedding").cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    both = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        scopes: dict[str | None, list[int]] = {}
        for i, scope in enumerate(rows.column("project_id").to_pylist()):
            scopes.setdefault(scope, []).append(i)
        unit = _unit(rows.column("v").combine_chunks(), dim) if rows.num_rows else np.empty((0, dim))
        shared = queries.sparkSession.sparkContext.broadcast((rows.column("query_id").to_pylist(), unit, {k: np.array(v) for k, v in scopes.items()}))
        part = known.mapInArrow(functools.partial(_best_in_batch, shared=shared, dim=dim, pool=pool), "query_id string, id string, cosine double")
        both = part if both is None else both.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id"))
    return both.withColumn("vec_rank", rank).where(F.col("vec_rank") <= pool)


def entity_matches(query_entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """``(query_id, id, overlap)``: share of a query's different entities that a memory of its project mentions."""
    asked = query_entities.where("project_id is not null").select("query_id", "project_id", "normalized_name").distinct()
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"))
    links = mentions.select(F.col("memory_id").alias("id"), "project_id", "normalized_name").distinct()
    hits = links.join(asked, ["project_id", "normalized_name"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("matched"))
    return hits.join(sizes, "query_id").select("query_id", "id", F.least(F.lit(1.0), F.col("matched") / F.col("asked")).alias("overlap"))


def entity_pool(matches: DataFrame, memories: DataFrame, pool: Column) -> DataFrame:
    """``(query_id, id)``: the newest ``pool`` memories that mention an entity of the query."""
    dated = matches.join(memories.select("id", "created_at"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "id"))
    return dated.withColumn("n", rank).where(F.col("n") <= pool).select("query_id", "id")


def merged(keyword: DataFrame, vector: DataFrame, entity: DataFrame, matches: DataFrame, sums: DataFrame, config: EngineConfig) -> DataFrame:
    """All candidates with their fused relevance: ``(query_id, id, kw_raw, cosine, overlap, relevance)``.

    The pools are stacked and grouped once instead of two full outer joins. Scales (best keyword
    rank, lowest and highest cosine) are of the whole pools, taken before the semantic gate.
    """
    none = lambda t: F.lit(None).cast(t)
    kw = keyword.select("query_id", "id", "kw_raw", "kw_rank", none("double").alias("cosine"), none("int").alias("vec_rank"), F.lit(0).alias("in_entity"), none("double").alias("overlap"))
    vec = vector.select("query_id", "id", none("double").alias("kw_raw"), none("int").alias("kw_rank"), "cosine", "vec_rank", F.lit(0).alias("in_entity"), none("double").alias("overlap"))
    ent = entity.select("query_id", "id", none("double").alias("kw_raw"), none("int").alias("kw_rank"), none("double").alias("cosine"), none("int").alias("vec_rank"), F.lit(1).alias("in_entity"), none("double").alias("overlap"))
    over = matches.select("query_id", "id", none("double").alias("kw_raw"), none("int").alias("kw_rank"), none("double").alias("cosine"), none("int").alias("vec_rank"), F.lit(-1).alias("in_entity"), "overlap")
    stacked = kw.unionByName(vec).unionByName(ent).unionByName(over)
    one = stacked.groupBy("query_id", "id").agg(
        F.max("kw_raw").alias("kw_raw"), F.max("kw_rank").alias("kw_rank"), F.max("cosine").alias("cosine"), F.max("vec_rank").alias("vec_rank"),
        F.max("in_entity").alias("in_entity"), F.max("overlap").alias("overlap"),
    )
    # A memory that only has overlap is in no pool, so it is no candidate.
    one = one.where("kw_rank is not null or vec_rank is not null or in_entity = 1").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    per = Window.partitionBy("query_id")
    one = one.withColumns({"top": F.max("kw_raw").over(per), "low": F.min("cosine").over(per), "high": F.max("cosine").over(per)})
    one = one.join(sums, "query_id", "left")
    other = F.col("kw_rank").isNotNull() | (F.col("in_entity") == 1)
    kept = one.where(S.gate(other, F.col("cosine"), config.gate))
    scale = S.keyword_scale(F.coalesce("top", F.lit(0.0)), S.full_match(F.col("idf_sum")), config.coverage)
    keyword_signal = F.when(scale > 0, F.coalesce("kw_raw", F.lit(0.0)) / scale).otherwise(0.0)
    wk, ws, we = config.weights
    if config.fusion == "rrf":
        relevance = S.fused_rrf(F.col("kw_rank"), F.col("vec_rank"), F.col("overlap"), wk, ws, we, config.rrf_k)
    elif config.fusion == "linear":
        # Ranks through a logistic, cosines as they are.
        relevance = S.fused(S.rank_normal(F.col("kw_raw"), F.coalesce("terms", F.lit(1))), F.col("cosine"), F.col("overlap"), wk, ws, we)
    else:
        vector_signal = F.when(F.col("cosine").isNotNull(), S.minmax(F.col("cosine"), F.col("low"), F.col("high")))
        relevance = S.fused(keyword_signal, vector_signal, F.col("overlap"), wk, ws, we)
    return kept.select("query_id", "id", "kw_raw", "kw_rank", "cosine", "vec_rank", "overlap", relevance.alias("relevance"))


def superseded_ids(edges: DataFrame) -> DataFrame:
    return edges.where("relationship = 'supersedes' and to_id is not null").select(F.col("to_id").alias("id")).distinct()


def scored(candidates: DataFrame, memories: DataFrame, edges: DataFrame, now: Column, top: Column) -> DataFrame:
    """The ``top`` best of each query by the final score, ties by id: ``(query_id, rank, id, relevance, superseded, score)``."""
    flags = superseded_ids(edges).withColumn("superseded", F.lit(True))
    rows = candidates.join(memories.select("id", "created_at", "access_count", "type"), "id").join(flags, "id", "left")
    superseded = F.coalesce("superseded", F.lit(False))
    score = S.final_score(F.col("relevance"), now, F.col("created_at"), F.col("access_count"), F.col("type"), superseded)
    rows = rows.select("query_id", "id", "relevance", superseded.alias("superseded"), F.round(score, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "id", "relevance", "superseded", "score")


def context(ids: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """``(id, position, relationship, target_id, target_content, weight)``: memory-to-memory edges of the ids in both directions, outgoing first."""
    asked = ids.select("id").distinct()
    known = memories.select(F.col("id").alias("target_id"), F.col("content").alias("target_content"))
    out = edges.join(asked, edges["from_id"] == asked["id"]).select(asked["id"], F.lit(0).alias("incoming"), "relationship", F.col("to_id").alias("target_id"), "weight")
    back = edges.join(asked, edges["to_id"] == asked["id"]).select(asked["id"], F.lit(1).alias("incoming"), "relationship", F.col("from_id").alias("target_id"), "weight")
    rows = out.unionByName(back).join(known, "target_id")
    return rows.select("id", "incoming", "relationship", "target_id", "target_content", "weight")


def with_context(results: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Results with ``context``: an array of (relationship, target_id, target_content, weight), outgoing edges first."""
    rows = context(results, edges, memories).select("id", F.struct("incoming", "relationship", "target_id", "target_content", "weight").alias("e"))
    packed = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e.dropFields("incoming")).alias("context"))
    return results.join(packed, "id", "left")


def query_batch(
    queries: DataFrame, memories: DataFrame, embeddings: DataFrame | None, mentions: DataFrame | None, edges: DataFrame, now: Column, config: EngineConfig | None = None, top_k: int = 5,
    posted: DataFrame | None = None,
) -> DataFrame:
    """Answer every row of ``queries(query_id, text, project_id[, embedding][, entities])`` in one plan.

    Result as of ``scored``. Queries whose words match nothing to search for fall back to the
    newest memories of their scope with relevance 0, beside what the vectors give. ``posted`` is a
    prebuilt index as ``postings`` makes it.
    """
    config = (config or EngineConfig()).validate()
    most_kw, most_vec, most_ent = pools(top_k)
    pool_kw, pool_ent = F.lit(most_kw), F.lit(most_ent)
    spark = queries.sparkSession
    # The index and the weighted terms are read several times below; they are written once.
    posted = stored(postings(memories), "postings") if posted is None else posted
    terms = query_terms(queries)
    weights = stored(term_weights(terms, posted, memories), "weights")
    keyword = keyword_pool(terms, weights, posted, pool_kw)
    if embeddings is not None and "embedding" in queries.columns:
        vector = vector_pool(queries, embeddings, most_vec, config.dim)
    else:
        vector = spark.createDataFrame([], "query_id string, id string, cosine double, vec_rank int")
    if mentions is not None and "entities" in queries.columns and config.graph_signals:
        asked = queries.select("query_id", "project_id", F.explode("entities").alias("e")).select("query_id", "project_id", X.normalize_entity(F.col("e")).alias("normalized_name"))
        matches = entity_matches(asked, mentions)
        entity = entity_pool(matches, memories, pool_ent)
    else:
        matches = spark.createDataFrame([], "query_id string, id string, overlap double")
        entity = matches.select("query_id", "id")
    sums = idf_sums(weights)
    candidates = merged(keyword, vector, entity, matches, sums, config)
    fallback = fallback_pool(queries, memories, most_kw).select("query_id", "id", F.lit(0.0).alias("relevance"))
    # One aggregate instead of an anti-join, which would work the candidates out twice.
    every = candidates.select("query_id", "id", "relevance").unionByName(fallback).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"))
    return scored(every, memories, edges, now, F.lit(top_k))


def fallback_pool(queries: DataFrame, memories: DataFrame, pool: int) -> DataFrame:
    """``(query_id, id)``: the newest memories in scope of queries without searchable words."""
    blank = queries.where(F.coalesce(F.size(X.keywords(F.col("text"))), F.lit(0)) <= 0).select("query_id", F.col("project_id").alias("scope"))
    newest = memories.select("id", "project_id", "created_at")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    per = newest.withColumn("n", place).where(F.col("n") <= pool)
    # At most ``pool`` rows, so the join with the unscoped queries is bounded on this side.
    every = newest.orderBy(F.desc("created_at"), "id").limit(pool).select("id", F.lit(1).alias("one"))
    scoped = per.join(blank.where("scope is not null"), F.col("project_id") == F.col("scope")).select("query_id", "id")
    free = blank.where("scope is null").withColumn("one", F.lit(1)).join(F.broadcast(every), "one").select("query_id", "id")
    return scoped.unionByName(free)
