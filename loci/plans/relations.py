"""Sources, sinks, filters, joins, aggregations, ranks and set operations over whole tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci import schema
from loci.functions import scoring as S
from loci.functions import text as X
from loci.operators import evaluate, extract, graph, ingest, maintain, memories, profile, retrieve
from loci.plans.base import ASKED, COSINE, DIM, EDG, EMB, MEM, MEN, SQL_NOW, posted, query, sql_keywords, sql_tokens
from loci.plans.texts import DECAY, HOURS, UUID5, VERDICT, final_sql, sig, sql_contradiction, sql_features
from loci.runtime import stored
from loci.sources import conversations

TJSON = "CASE WHEN len(tags) = 0 THEN '[]' ELSE '[\"' || array_to_string(tags, '\",\"') || '\"]' END"
MICROS = "epoch_us(created_at) AS created_us"


def micros(c: str = "created_at"):
    return F.unix_micros(c).alias("created_us")


# --- sources -------------------------------------------------------------------------------------


@query("src_init", "SELECT 'memories' AS name, count(*) AS n FROM memories UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'mentions', count(*) FROM mentions")
def _(t):
    kinds = {"memories": schema.MEMORIES, "edges": schema.EDGES, "entities": schema.ENTITIES, "mentions": schema.MENTIONS}
    out = None
    for name, kind in kinds.items():
        one = schema.validate_schema(t.raw(name), kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src_dimcheck", "SELECT CASE WHEN embedding IS NOT NULL THEN len(embedding) END::BIGINT AS dim, count(*) AS n FROM memory_embeddings GROUP BY 1")
def _(t):
    return schema.dimension(t.raw("memory_embeddings"))


@query("src_scan_memory", f"WITH {MEM} SELECT id, content, type, project_id, access_count, decay_score::DOUBLE AS decay_score FROM mem WHERE id = (SELECT min(from_id) FROM edges WHERE from_id IN (SELECT id FROM mem))")
def _(t):
    first = t.raw("edges").join(t.memories.select(F.col("id").alias("from_id")), "from_id", "left_semi").agg(F.min("from_id").alias("id")).first()["id"]
    return memories.by_id(t.memories, first).select("id", "content", "type", "project_id", "access_count", "decay_score")


def _matches(words):
    return " + ".join(f"CASE WHEN contains(lower(coalesce(content, '')), '{w}') OR contains(lower({TJSON}), '{w}') THEN 1 ELSE 0 END" for w in words)


WORDS = ["gateway", "parser", "kafka"]


@query("src_scan_list", f"WITH {MEM}, m AS (SELECT id, ({_matches(WORDS)})::INTEGER AS matches, {MICROS} FROM mem WHERE type IN ('semantic', 'procedural')) SELECT * FROM m WHERE matches > 0")
def _(t):
    return memories.listing(t.memories, None, ["semantic", "procedural"], WORDS).select("id", "matches", micros())


@query("top_recent", f"WITH {MEM}, m AS (SELECT id, ({_matches(WORDS)})::INTEGER AS matches, {MICROS} FROM mem) SELECT * FROM m WHERE matches > 0 ORDER BY matches DESC, created_us DESC, id LIMIT 50")
def _(t):
    return memories.listing(t.memories, None, None, WORDS, 50).select("id", "matches", micros())


@query("flt_contains", f"WITH {MEM} SELECT id FROM mem WHERE ({_matches(WORDS)}) > 0")
def _(t):
    return t.memories.where(memories.match_count(WORDS) > 0).select("id")


@query("prj_matchcount", f"WITH {MEM} SELECT id, ({_matches(WORDS)})::INTEGER AS matches FROM mem")
def _(t):
    return t.memories.select("id", memories.match_count(WORDS).alias("matches"))


@query("src_count", f"WITH {MEM}, {EDG}, {MEN} SELECT (SELECT count(*) FROM mem) + (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM edg) + (SELECT count(*) FROM men) AS edges")
def _(t):
    return graph.counts(t.memories, t.entities, t.edges, t.mentions)


@query("src_ping", "SELECT 1::BIGINT AS n")
def _(t):
    return t.spark.range(1).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_turns",
    f"SELECT {UUID5.format(namespace=conversations.NAMESPACE, name="conversation || '/' || item_id::VARCHAR")} AS id, conversation, passage AS content, epoch_us(TIMESTAMPTZ '2026-08-30 10:00:00+00') + 60000000 * (item_id % 7 + 1) AS created_us FROM eval_items",
)
def _(t):
    items = t.raw("eval_items").select("conversation", F.col("item_id").cast("string").alias("dia_id"), (F.col("item_id") % 7 + 1).cast("int").alias("session"), F.col("passage").alias("content"))
    return conversations.turns_corpus(items).select("id", "conversation", "content", micros())


@query("src_world", "SELECT c.id AS customer_id, count(i.id) AS invoices, coalesce(sum(i.amount), 0)::BIGINT AS amount FROM world_customers c LEFT JOIN world_invoices i ON i.customer_id = c.id GROUP BY 1")
def _(t):
    i = t.raw("world_invoices", "id", "customer_id", "amount").withColumnRenamed("id", "invoice_id")
    c = t.raw("world_customers", "id").withColumnRenamed("id", "customer_id")
    return c.join(i, "customer_id", "left").groupBy("customer_id").agg(F.count("invoice_id").alias("invoices"), F.coalesce(F.sum("amount"), F.lit(0)).cast("bigint").alias("amount"))


# --- sinks: the table after the write ---------------------------------------------------------------


@query("sink_memory", f"WITH {MEM} SELECT id, content, 0::BIGINT AS access_count, 1.0::DOUBLE AS decay_score, CASE WHEN content IS NULL OR len({sql_tokens('content')}) = 0 THEN '' ELSE substring(sha256(array_to_string({sql_tokens('content')}, ' ')), 1, 32) END AS content_hash FROM mem")
def _(t):
    return t.memories.select("id", "content", F.lit(0).cast("bigint").alias("access_count"), F.lit(1.0).alias("decay_score"), X.content_hash(F.col("content")).alias("content_hash"))


@query("sink_embedding", f"WITH {EMB} SELECT memory_id, round(embedding[1]::DOUBLE, 6) AS first FROM emb")
def _(t):
    new = t.raw("memory_embeddings").withColumn("created_at", F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp")))
    after = graph.upsert_embeddings(new, new.where(F.lit(False)), DIM)
    return after.select("memory_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("sink_edge", f"WITH {EDG} SELECT id, from_id, to_id, relationship, weight::DOUBLE AS weight FROM edg")
def _(t):
    return t.edges.select("id", "from_id", "to_id", "relationship", "weight")


@query("sink_edges", f"WITH {MEM}, {EDG} SELECT id, from_id, to_id, relationship, weight::DOUBLE AS weight FROM edg WHERE from_id IN (SELECT id FROM mem) AND to_id IN (SELECT id FROM mem)")
def _(t):
    new = t.raw("edges")
    return graph.add_edges(new, new.where(F.lit(False)), t.memories).select("id", "from_id", "to_id", "relationship", "weight")


@query("sink_entities", f"""WITH {MEN}, m AS (SELECT DISTINCT normalized_name, project_id FROM men WHERE coalesce(project_id, '') <> '' AND normalized_name IS NOT NULL AND trim(normalized_name) <> '')
SELECT project_id, count(*) AS n FROM m GROUP BY 1""")
def _(t):
    named = t.mentions.groupBy(F.col("memory_id").alias("id"), "project_id").agg(F.sort_array(F.collect_set("normalized_name")).alias("entities"))
    nothing = t.raw("entities").where(F.lit(False))
    links = t.raw("mentions").where(F.lit(False))
    after, _ = graph.link_entities(named, nothing, links, t.now)
    return after.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("sink_delete", f"""WITH {MEM}, {EDG}, {MEN}, gone AS (SELECT id FROM mem WHERE type = 'episodic'), left_ AS (SELECT * FROM men WHERE memory_id NOT IN (SELECT id FROM gone)),
lost AS (SELECT DISTINCT normalized_name, project_id FROM men WHERE memory_id IN (SELECT id FROM gone))
SELECT 'memories' AS name, count(*) AS n FROM mem WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*) FROM edg WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'mentions', count(*) FROM left_
UNION ALL SELECT 'entities', count(*) FROM entities e WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.normalized_name = e.normalized_name AND l.project_id = e.project_id
  AND NOT EXISTS (SELECT 1 FROM left_ r WHERE r.normalized_name = l.normalized_name AND r.project_id = l.project_id))""")
def _(t):
    tables = {"memories": t.memories, "embeddings": t.embeddings, "edges": t.edges, "mentions": t.mentions, "entities": t.entities}
    after = graph.delete(t.memories.where("type = 'episodic'").select("id"), tables)
    out = None
    for name in ("memories", "edges", "mentions", "entities"):
        one = after[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_update_access", f"WITH {MEM}, {MEN}, r AS (SELECT memory_id, count(*) AS n FROM men GROUP BY 1) SELECT id, (access_count + coalesce(n, 0))::BIGINT AS access_count FROM mem LEFT JOIN r ON r.memory_id = mem.id")
def _(t):
    return graph.with_access(t.memories, t.mentions.select("memory_id")).select("id", "access_count")


@query("sink_update_decay", f"WITH {MEM} SELECT id, round({DECAY}, 6)::DOUBLE AS decay_score FROM mem")
def _(t):
    return maintain.decay_phase(t.memories, t.now).select("id", F.round("decay_score", 6).alias("decay_score"))


@query("sink_update_content", f"""WITH {MEM}, h AS (SELECT *, CASE WHEN content IS NULL OR len({sql_tokens('content')}) = 0 THEN '' ELSE substring(sha256(array_to_string({sql_tokens('content')}, ' ')), 1, 32) END AS now_hash FROM mem)
SELECT id, CASE WHEN content_hash = now_hash AND regexp_matches(content_hash, '^[0-9a-f]{{32}}$') THEN content || ' (checked)' ELSE content END AS content FROM h""")
def _(t):
    changes = t.memories.where(X.is_content_hash(F.col("content_hash"))).select("id", F.col("content_hash").alias("expected_hash"), F.concat("content", F.lit(" (checked)")).alias("new_content"))
    return graph.update_content(changes.where("new_content is not null"), t.memories).select("id", "content")


@query("sink_session", "SELECT user_id::VARCHAR AS agent_id, count(*) AS events FROM events GROUP BY 1")
def _(t):
    runs = profile.sessions_by_gap(t.raw("events"), "user_id", "ts")
    return runs.groupBy(F.col("user_id").cast("string").alias("agent_id")).agg(F.sum("events").alias("events"))


@query(
    "sink_digest",
    """WITH v AS (SELECT trace_id, memory_id, max(vector) AS v FROM trace_candidates GROUP BY 1, 2),
r AS (SELECT trace_id, memory_id, row_number() OVER (PARTITION BY trace_id ORDER BY v DESC NULLS LAST, memory_id) AS n FROM v),
h AS (SELECT trace_id, sha256(trace_id::VARCHAR || ':' || string_agg(memory_id, ',' ORDER BY n)) AS h FROM r GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY trace_id)) AS digest FROM h""",
)
def _(t):
    return evaluate.digest(t.raw("trace_candidates").groupBy("trace_id", "memory_id").agg(F.max("vector").alias("v")).select(
        F.col("trace_id").alias("question_id"), F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("v"), "memory_id")).alias("rank"), F.col("memory_id").alias("id")))


# --- filters -----------------------------------------------------------------------------------------


@query("flt_project", f"WITH {MEM} SELECT id FROM mem WHERE project_id = (SELECT min(project_id) FROM mem)")
def _(t):
    first = t.memories.agg(F.min("project_id").alias("p")).first()["p"]
    return memories.in_project(t.memories, first).select("id")


@query("flt_types", f"WITH {MEM} SELECT id, type FROM mem WHERE type IN ('semantic', 'procedural')")
def _(t):
    return memories.of_types(t.memories, ["semantic", "procedural", "unknown"]).select("id", "type")


QUESTION_TERMS = f"qt AS (SELECT item_id::VARCHAR AS query_id, unnest({sql_keywords('question')}) AS term FROM eval_items)"


@query("flt_fts", f"WITH {MEM}, {posted()}, {QUESTION_TERMS} SELECT query_id, count(DISTINCT p.id) AS hits FROM qt JOIN posted p ON p.token = qt.term GROUP BY 1")
def _(t):
    terms = retrieve.query_terms(t.questions).select("query_id", F.col("term").alias("token"))
    return retrieve.postings(t.memories).join(terms, "token").select("query_id", "id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query("flt_searchable", f"SELECT item_id::VARCHAR AS query_id, len({sql_keywords('question')}) > 0 AS searchable FROM eval_items")
def _(t):
    return t.questions.select("query_id", (F.size(X.keywords(F.col("text"))) > 0).alias("searchable"))


HASHED = f"h AS (SELECT id, project_id, type, substring(sha256(array_to_string({sql_tokens('content')}, ' ')), 1, 32) AS hash FROM mem WHERE content IS NOT NULL AND len({sql_tokens('content')}) > 0)"


@query("flt_hash_in", f"WITH {MEM}, {HASHED}, f AS (SELECT project_id, hash, type, min(id) AS existing_id FROM h WHERE project_id IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3) SELECT h.id, f.existing_id FROM h LEFT JOIN f USING (project_id, hash, type)")
def _(t):
    rows = t.memories.where("content is not null").where(F.size(X.content_tokens(F.col("content"))) > 0)
    return memories.duplicates_by_hash(rows.select("id", "content", "type", "project_id"), t.memories).select("id", "existing_id")


@query("jn_dup", f"WITH {MEM}, {HASHED}, f AS (SELECT project_id, hash, type, min(id) AS existing_id FROM h WHERE project_id IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2, 3) SELECT (f.existing_id IS NOT NULL AND f.existing_id <> h.id) AS known, count(*) AS n FROM h LEFT JOIN f USING (project_id, hash, type) GROUP BY 1")
def _(t):
    rows = t.memories.where("content is not null").where(F.size(X.content_tokens(F.col("content"))) > 0)
    found = memories.duplicates_by_hash(rows.select("id", "content", "type", "project_id"), t.memories)
    known = F.coalesce(F.col("existing_id") != F.col("id"), F.lit(False))
    return found.groupBy(known.alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_ids_in", f"WITH {MEM}, {EDG} SELECT id FROM mem WHERE id IN (SELECT to_id FROM edg)")
def _(t):
    return t.memories.join(t.edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi").select("id")


@query("flt_nan", "SELECT trace_id, memory_id FROM trace_candidates WHERE vector IS NOT NULL AND NOT isnan(vector) GROUP BY 1, 2")
def _(t):
    return t.raw("trace_candidates").where("vector is not null and not isnan(vector)").select("trace_id", "memory_id").distinct()


@query("flt_gate", "SELECT DISTINCT trace_id, memory_id FROM trace_candidates WHERE keyword IS NOT NULL OR entity IS NOT NULL OR vector IS NULL OR vector >= 0.5")
def _(t):
    other = F.col("keyword").isNotNull() | F.col("entity").isNotNull()
    return t.raw("trace_candidates").where(S.gate(other, F.col("vector"), 0.5)).select("trace_id", "memory_id").distinct()


@query("flt_recent", f"WITH {MEM} SELECT id FROM mem WHERE created_at > {SQL_NOW} - INTERVAL 90 DAY")
def _(t):
    return t.memories.where(F.col("created_at") > t.now - F.make_dt_interval(F.lit(90))).select("id")


STALE = f"decay_score < 0.1 AND access_count = 0 AND ({HOURS}) / 24 > 30"


@query("flt_prune", f"WITH {MEM} SELECT id FROM mem WHERE {STALE}")
def _(t):
    return maintain.stale(t.memories, t.now).select("id")


# --- retrieval: one SQL chain, cut at each stage --------------------------------------------------------

NAMES = "nm AS (SELECT men.project_id, men.normalized_name, asked.query_id FROM asked JOIN men ON men.memory_id = asked.mid AND men.project_id = asked.project_id WHERE men.normalized_name IS NOT NULL)"


def chain(pool_kw: int = 50, pool_vec: int = 50, pool_ent: int = 25, fusion: str = "minmax") -> str:
    relevance = {
        "minmax": "(0.45 * least(1.0, kwsig) + 0.4 * CASE WHEN cosine IS NULL THEN 0.0 WHEN hi <= lo THEN 1.0 ELSE (cosine - lo) / (hi - lo) END + 0.15 * overlap)",
        "linear": "(0.45 * CASE WHEN coalesce(kw_raw, 0) <= 0 THEN 0.0 ELSE 1 / (1 + exp(-(2.3 / (0.04 * terms)) * (kw_raw - 0.04 * terms))) END + 0.4 * greatest(0.0, least(1.0, coalesce(cosine, 0.0))) + 0.15 * overlap)",
        "rrf": "(coalesce(0.45 / (60 + kw_rank), 0) + coalesce(0.4 / (60 + vec_rank), 0) + 0.15 / 61 * overlap) / (1.0 / 61)",
    }[fusion]
    return f"""{MEM}, {EMB}, {EDG}, {MEN}, {ASKED}, {posted()}, {NAMES},
qt AS (SELECT query_id, project_id, term, count(*) AS times FROM (SELECT query_id, project_id, unnest({sql_keywords('text')}) AS term FROM asked) GROUP BY 1, 2, 3),
sz AS (SELECT project_id, count(*) AS n FROM mem WHERE project_id IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM mem),
dfs AS (SELECT project_id, token, count(*) AS df FROM posted WHERE project_id IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT NULL, token, count(*) FROM posted GROUP BY 2),
wt AS (SELECT query_id, qt.project_id, term, times, greatest(coalesce(df, 0), 1) AS df, n, ln(1 + (n - greatest(coalesce(df, 0), 1) + 0.5) / (greatest(coalesce(df, 0), 1) + 0.5)) AS idf
  FROM qt LEFT JOIN dfs ON dfs.project_id IS NOT DISTINCT FROM qt.project_id AND dfs.token = qt.term JOIN sz ON sz.project_id IS NOT DISTINCT FROM qt.project_id),
sums AS (SELECT query_id, sum(times * idf) AS idf_sum, sum(times) AS terms FROM wt GROUP BY 1),
kraw AS (SELECT query_id, p.id, sum(times * idf * 0.1 * tf) AS kw_raw FROM wt JOIN posted p ON p.token = wt.term AND (wt.project_id IS NULL OR p.project_id = wt.project_id) GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(kw_raw, 9) DESC, id) AS kw_rank FROM kraw WHERE kw_raw > 0 QUALIFY kw_rank <= {pool_kw}),
vraw AS (SELECT query_id, emb.memory_id AS id, {COSINE.format(a='asked.embedding', b='emb.embedding')} AS cosine FROM asked JOIN emb ON emb.project_id = asked.project_id),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS vec_rank FROM vraw QUALIFY vec_rank <= {pool_vec}),
en AS (SELECT query_id, count(*) AS asked_n FROM nm GROUP BY 1),
over_ AS (SELECT nm.query_id, men.memory_id AS id, least(1.0, count(*) / any_value(asked_n)) AS overlap FROM nm JOIN men ON men.project_id = nm.project_id AND men.normalized_name = nm.normalized_name JOIN en ON en.query_id = nm.query_id GROUP BY 1, 2),
ent AS (SELECT query_id, over_.id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, over_.id) AS n FROM over_ JOIN mem ON mem.id = over_.id QUALIFY n <= {pool_ent}),
ids AS (SELECT query_id, id FROM kw UNION SELECT query_id, id FROM vec UNION SELECT query_id, id FROM ent),
one AS (SELECT ids.query_id, ids.id, kw_raw, kw_rank, cosine, vec_rank, ent.n IS NOT NULL AS in_ent, coalesce(overlap, 0.0) AS overlap FROM ids
  LEFT JOIN kw ON kw.query_id = ids.query_id AND kw.id = ids.id LEFT JOIN vec ON vec.query_id = ids.query_id AND vec.id = ids.id
  LEFT JOIN ent ON ent.query_id = ids.query_id AND ent.id = ids.id LEFT JOIN over_ ON over_.query_id = ids.query_id AND over_.id = ids.id),
scaled AS (SELECT *, max(kw_raw) OVER (PARTITION BY query_id) AS top, min(cosine) OVER (PARTITION BY query_id) AS lo, max(cosine) OVER (PARTITION BY query_id) AS hi FROM one),
sig AS (SELECT s.*, idf_sum, terms, CASE WHEN coalesce(top, 0) <= 0 THEN 0.0 ELSE coalesce(kw_raw, 0) / CASE WHEN 0.1 * idf_sum > 0 THEN top ** 0.75 * (0.1 * idf_sum) ** 0.25 ELSE top END END AS kwsig
  FROM scaled s LEFT JOIN sums ON sums.query_id = s.query_id),
cand AS (SELECT query_id, id, kw_raw, cosine, overlap, {relevance} AS relevance FROM sig WHERE kw_rank IS NOT NULL OR in_ent OR cosine IS NULL OR cosine >= 0.15)"""


class Pools:
    """The stages of the asked questions, for five results; each is built when it is asked for."""

    def __init__(self, t) -> None:
        self.t, self.asked = t, t.asked

    @property
    def postings(self):
        return self.t.index

    @cached_property
    def terms(self):
        return retrieve.query_terms(self.asked)

    @cached_property
    def weights(self):
        return stored(retrieve.term_weights(self.terms, self.postings, self.t.kept), "weights")

    @cached_property
    def keyword(self):
        return retrieve.keyword_pool(self.terms, self.weights, self.postings, F.lit(50))

    @cached_property
    def vector(self):
        return retrieve.vector_pool(self.asked.select("query_id", "project_id", "embedding"), self.t.embeddings, 50, DIM)

    @cached_property
    def matches(self):
        named = self.asked.select("query_id", "project_id", F.explode("entities").alias("normalized_name"))
        return retrieve.entity_matches(named, self.t.mentions)

    @cached_property
    def entity(self):
        return retrieve.entity_pool(self.matches, self.t.memories, F.lit(25))


@query("agg_df", f"WITH {chain()} SELECT query_id, term, df::BIGINT AS df FROM wt")
def _(t):
    return Pools(t).weights.select("query_id", "term", F.col("df").cast("bigint").alias("df"))


@query("agg_n", f"WITH {MEM} SELECT project_id, count(*) AS n FROM mem WHERE project_id IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM mem")
def _(t):
    return retrieve.corpus_sizes(t.memories)


@query("m_idf", f"WITH {chain()} SELECT query_id, term, round(idf, 6)::DOUBLE AS idf FROM wt")
def _(t):
    return Pools(t).weights.select("query_id", "term", F.round("idf", 6).alias("idf"))


@query("agg_idfsum", f"WITH {chain()} SELECT query_id, round(idf_sum, 6)::DOUBLE AS idf_sum, terms::BIGINT AS terms FROM sums")
def _(t):
    return retrieve.idf_sums(Pools(t).weights).select("query_id", F.round("idf_sum", 6).alias("idf_sum"), F.col("terms").cast("bigint").alias("terms"))


@query("agg_rank", f"WITH {chain()} SELECT query_id, id, round(kw_raw, 6)::DOUBLE AS raw FROM kraw")
def _(t):
    p = Pools(t)
    return retrieve.keyword_pool(p.terms, p.weights, p.postings, F.lit(2**31 - 1)).select("query_id", "id", F.round("kw_raw", 6).alias("raw"))


@query("fts_rank", f"WITH {MEM}, {posted()} SELECT id, token, round(0.1 * tf, 6)::DOUBLE AS rank FROM posted")
def _(t):
    return retrieve.postings(t.memories).select("id", "token", F.round(S.RANK_PER_TERM * F.col("tf"), 6).alias("rank"))


@query("jn_fts", f"WITH {chain()} SELECT query_id, p.id, term FROM qt JOIN posted p ON p.token = qt.term AND (qt.project_id IS NULL OR p.project_id = qt.project_id)")
def _(t):
    p = Pools(t)
    terms = p.terms
    words = terms.select("query_id", "project_id", F.col("term").alias("token"))
    scoped = p.postings.join(words.where("project_id is not null"), ["project_id", "token"]).select("query_id", "id", F.col("token").alias("term"))
    free = p.postings.drop("project_id").join(words.where("project_id is null").drop("project_id"), "token").select("query_id", "id", F.col("token").alias("term"))
    return scoped.unionByName(free)


@query("jn_corpus", f"WITH {chain()} SELECT query_id, term, n::BIGINT AS n FROM wt")
def _(t):
    return Pools(t).weights.select("query_id", "term", F.col("n").cast("bigint").alias("n"))


KW_SQL = f"WITH {chain()} SELECT query_id, id, round(kw_raw, 6)::DOUBLE AS raw, kw_rank::BIGINT AS rank FROM kw"
for _name in ("op_keyword", "top_keyword", "win_kwrank"):

    @query(_name, KW_SQL)
    def _(t):
        return Pools(t).keyword.select("query_id", "id", F.round("kw_raw", 6).alias("raw"), F.col("kw_rank").cast("bigint").alias("rank"))


VEC_SQL = f"WITH {chain()} SELECT query_id, id, round(cosine, 6)::DOUBLE AS cosine, vec_rank::BIGINT AS rank FROM vec"
for _name in ("op_vector", "top_vector_scoped", "win_vecrank"):

    @query(_name, VEC_SQL)
    def _(t):
        return Pools(t).vector.select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("vec_rank").cast("bigint").alias("rank"))


@query("top_vector_global", f"""WITH {MEM}, {EMB}, {ASKED}, v AS (SELECT query_id, memory_id AS id, {COSINE.format(a='asked.embedding', b='emb.embedding')} AS cosine FROM asked, emb WHERE asked.embedding IS NOT NULL)
SELECT query_id, id, round(cosine, 6)::DOUBLE AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM v QUALIFY rank <= 50""")
def _(t):
    free = t.asked.select("query_id", F.lit(None).cast("string").alias("project_id"), "embedding")
    return retrieve.vector_pool(free, t.embeddings, 50, DIM).select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.col("vec_rank").cast("bigint").alias("rank"))


@query("jn_hydrate_kw", f"WITH {chain()} SELECT kw.query_id, kw.kw_rank::BIGINT AS rank, mem.id, mem.content, mem.type FROM kw JOIN mem ON mem.id = kw.id")
def _(t):
    return Pools(t).keyword.join(t.memories.select("id", "content", "type"), "id").select("query_id", F.col("kw_rank").cast("bigint").alias("rank"), "id", "content", "type")


@query("jn_hydrate_vec", f"WITH {chain()} SELECT vec.query_id, vec.vec_rank::BIGINT AS rank, mem.id, mem.content, mem.type FROM vec JOIN mem ON mem.id = vec.id")
def _(t):
    return Pools(t).vector.join(t.memories.select("id", "content", "type"), "id").select("query_id", F.col("vec_rank").cast("bigint").alias("rank"), "id", "content", "type")


OVER_SQL = f"WITH {chain()} SELECT query_id, id, round(overlap, 6)::DOUBLE AS overlap FROM over_"
for _name in ("jn_mentions_count", "agg_entity_overlap", "set_entity_overlap"):

    @query(_name, OVER_SQL)
    def _(t):
        return Pools(t).matches.select("query_id", "id", F.round("overlap", 6).alias("overlap"))


ENT_SQL = f"WITH {chain()} SELECT query_id, id FROM ent"
for _name in ("op_entity", "jn_mentions_find", "top_entity"):

    @query(_name, ENT_SQL)
    def _(t):
        return Pools(t).entity


@query("jn_mentions_list", f"WITH {MEN} SELECT memory_id, string_agg(normalized_name, ',' ORDER BY normalized_name) AS names FROM men GROUP BY 1")
def _(t):
    return t.mentions.groupBy("memory_id").agg(F.array_join(F.sort_array(F.collect_list("normalized_name")), ",").alias("names"))


def candidates(t, fusion="minmax"):
    from loci.config import EngineConfig

    p = Pools(t)
    return retrieve.merged(p.keyword, p.vector, p.entity, p.matches, retrieve.idf_sums(p.weights), EngineConfig(dim=DIM, fusion=fusion))


for _name, _fusion in (("op_merge", "minmax"), ("jn_merge3", "minmax"), ("fuse_linear", "linear"), ("win_rrf", "rrf")):

    @query(_name, f"WITH {chain(fusion=_fusion)} SELECT query_id, id, round(relevance, 6)::DOUBLE AS relevance FROM cand")
    def _(t, fusion=_fusion):
        return candidates(t, fusion).select("query_id", "id", F.round("relevance", 6).alias("relevance"))


@query("agg_minmax", f"WITH {chain()} SELECT query_id, round(max(top), 6)::DOUBLE AS top, round(min(lo), 6)::DOUBLE AS low, round(max(hi), 6)::DOUBLE AS high FROM scaled GROUP BY 1")
def _(t):
    p = Pools(t)
    keyword, vector, entity = p.keyword, p.vector, p.entity
    ids = keyword.select("query_id").unionAll(vector.select("query_id")).unionAll(entity.select("query_id")).distinct()
    a = keyword.groupBy("query_id").agg(F.round(F.max("kw_raw"), 6).alias("top"))
    b = vector.groupBy("query_id").agg(F.round(F.min("cosine"), 6).alias("low"), F.round(F.max("cosine"), 6).alias("high"))
    return ids.join(a, "query_id", "left").join(b, "query_id", "left")


@query("set_dedup_ids", f"WITH {chain()} SELECT query_id, id FROM ids")
def _(t):
    p = Pools(t)
    keyword, vector, entity = p.keyword, p.vector, p.entity
    return keyword.select("query_id", "id").unionAll(vector.select("query_id", "id")).unionAll(entity).distinct()


FINAL = f"""fall AS (
  SELECT a.query_id, mem.id FROM asked a JOIN mem ON mem.project_id = a.project_id WHERE a.query_id NOT IN (SELECT query_id FROM qt)
  QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY created_at DESC, mem.id) <= 50),
every AS (SELECT query_id, id, relevance FROM cand UNION ALL SELECT query_id, id, 0.0 FROM fall WHERE (query_id, id) NOT IN (SELECT query_id, id FROM cand)),
ranked AS (
  SELECT every.query_id, every.id, relevance, mem.id IN (SELECT to_id FROM edg WHERE relationship = 'supersedes') AS superseded,
    round({final_sql('relevance', "mem.id IN (SELECT to_id FROM edg WHERE relationship = 'supersedes')")}, 9) AS score
  FROM every JOIN mem ON mem.id = every.id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ranked QUALIFY rank <= 5)"""
FINAL_SQL = f"WITH {chain()}, {FINAL} SELECT query_id, rank, id, superseded, round(score, 6)::DOUBLE AS score FROM best"


def retrieved(t):
    from loci.config import EngineConfig

    full = t.asked.select("query_id", "text", "project_id", "embedding", "entities")
    return retrieve.query_batch(full, t.kept, t.embeddings, t.mentions, t.edges, t.now, EngineConfig(dim=DIM), 5, t.index)


for _name in ("op_retrieve", "api_query", "top_score"):

    @query(_name, FINAL_SQL)
    def _(t):
        return retrieved(t).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "superseded", F.round("score", 6).alias("score"))


@query("jn_superseded", f"WITH {MEM}, {EDG} SELECT id FROM mem WHERE id IN (SELECT to_id FROM edg WHERE relationship = 'supersedes')")
def _(t):
    return t.memories.join(retrieve.superseded_ids(t.edges), "id", "left_semi").select("id")


@query("op_supersede_flag", f"WITH {MEM}, {EDG} SELECT id, id IN (SELECT to_id FROM edg WHERE relationship = 'supersedes') AS superseded FROM mem")
def _(t):
    flags = retrieve.superseded_ids(t.edges).withColumn("superseded", F.lit(True))
    return t.memories.select("id").join(flags, "id", "left").select("id", F.coalesce("superseded", F.lit(False)).alias("superseded"))


CONTEXT = """ctx AS (
  SELECT from_id AS id, 0 AS incoming, relationship, to_id AS target_id, weight FROM edg WHERE from_id IN (SELECT id FROM mem)
  UNION ALL SELECT to_id, 1, relationship, from_id, weight FROM edg WHERE to_id IN (SELECT id FROM mem))"""
for _name in ("jn_context", "set_union_dir"):

    @query(_name, f"WITH {MEM}, {EDG}, {CONTEXT} SELECT ctx.id, incoming::INTEGER AS incoming, relationship, target_id, weight::DOUBLE AS weight FROM ctx JOIN mem ON mem.id = target_id")
    def _(t):
        return retrieve.context(t.memories, t.edges, t.memories).select("id", "incoming", "relationship", "target_id", "weight")


@query("jn_subgraph", f"""WITH {MEM}, {EDG} SELECT DISTINCT c.id AS centre, m.id AS id FROM mem c JOIN (SELECT from_id AS a, to_id AS b FROM edg UNION SELECT to_id, from_id FROM edg) e ON e.a = c.id JOIN mem m ON m.id = e.b""")
def _(t):
    return graph.subgraph(t.memories.select("id"), t.edges, t.memories)[0].select("centre", "id")


@query("jn_edges_around", f"""WITH {MEM}, {EDG} SELECT DISTINCT c.id AS centre, e.id, e.relationship FROM mem c JOIN edg e ON e.from_id = c.id JOIN mem o ON o.id = e.to_id
UNION SELECT c.id, e.id, e.relationship FROM mem c JOIN edg e ON e.to_id = c.id JOIN mem o ON o.id = e.from_id""")
def _(t):
    return graph.edges_around(t.memories.select("id"), t.edges, t.memories).select("centre", "id", "relationship")


@query("api_graph", f"""WITH RECURSIVE {MEM}, {EDG}, b AS (SELECT from_id AS a, to_id AS b FROM edg UNION SELECT to_id, from_id FROM edg),
one AS (SELECT DISTINCT c.id AS centre, b.b AS id FROM mem c JOIN b ON b.a = c.id),
two AS (SELECT DISTINCT one.centre, b.b AS id FROM one JOIN b ON b.a = one.id WHERE (one.centre, b.b) NOT IN (SELECT centre, id FROM one)),
hops AS (SELECT *, 1 AS distance FROM one UNION ALL SELECT *, 2 FROM two)
SELECT centre, h.id, distance::INTEGER AS distance FROM hops h JOIN mem ON mem.id = h.id""")
def _(t):
    return graph.subgraph(t.memories.select("id"), t.edges, t.memories, depth=2)[0].select("centre", "id", "distance")


@query("jn_orphans", "SELECT id, normalized_name FROM entities e WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.normalized_name = e.normalized_name AND m.project_id = e.project_id)")
def _(t):
    return graph.orphans(t.entities, t.mentions).select("id", "normalized_name")


# --- writes ------------------------------------------------------------------------------------------


#: Semantic memories against the newest 50 semantic ones of their project.
CONTRADICTED = f"""sem AS (SELECT id, project_id, created_at, {sql_features('content', 'tags')} AS f FROM mem WHERE type = 'semantic' AND content IS NOT NULL AND project_id IS NOT NULL),
last50 AS (SELECT * FROM sem QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 50),
con AS (SELECT a.id AS new_id, b.id AS old_id, {sql_contradiction('a.f', 'b.f')} AS c FROM sem a JOIN last50 b ON b.project_id = a.project_id AND b.id <> a.id)"""


@query("jn_contradict", f"WITH {MEM}, {CONTRADICTED} SELECT new_id, old_id, c.reason AS reason, c.confidence AS confidence FROM con WHERE c.confidence >= 0.5")
def _(t):
    return ingest.contradictions(t.memories, t.memories).select("new_id", "old_id", "reason", "confidence")


@query(
    "op_supersede",
    f"""WITH {MEM}, {CONTRADICTED} SELECT new_id AS from_id, old_id AS to_id, 'supersedes' AS relationship, c.confidence AS weight FROM con WHERE c.confidence >= 0.5
QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY c.confidence DESC, old_id) <= 5""",
)
def _(t):
    return ingest.supersessions(ingest.contradictions(t.memories, t.memories))


@query("flt_min_conf", f"WITH {MEM}, {CONTRADICTED} SELECT (c IS NOT NULL AND c.confidence >= 0.5) AS kept, count(*) AS n FROM con GROUP BY 1")
def _(t):
    """How many of the compared pairs reach the least confidence of 0.5."""
    found = ingest.contradictions(t.memories, t.memories).select("new_id", "old_id", F.lit(True).alias("kept"))
    new = t.memories.where("type = 'semantic' and content is not null and project_id is not null").select(F.col("id").alias("new_id"), "project_id")
    old = ingest.newest(t.memories.where("type = 'semantic' and content is not null"), ingest.SUPERSEDE_CANDIDATES).select(F.col("id").alias("old_id"), "project_id")
    every = new.join(old, "project_id").where("new_id <> old_id").join(found, ["new_id", "old_id"], "left")
    return every.groupBy(F.coalesce("kept", F.lit(False)).alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("top_super", f"WITH {EDG} SELECT from_id, to_id FROM edg WHERE relationship = 'supersedes' QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY weight DESC, to_id) <= 5")
def _(t):
    found = t.edges.where("relationship = 'supersedes'").select(F.col("from_id").alias("new_id"), F.col("to_id").alias("old_id"), F.col("weight").alias("confidence"))
    return ingest.supersessions(found).select("from_id", "to_id")


RECENT10 = "recent AS (SELECT id, project_id, tags FROM mem QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 10)"
TAGGED = """tagged AS (SELECT m.id AS new_id, r.id AS other_id FROM mem m JOIN recent r ON r.project_id = m.project_id AND r.id <> m.id
  WHERE len(list_intersect(list_transform(m.tags, lambda x: lower(x)), list_transform(r.tags, lambda x: lower(x)))) > 0)"""


@query("jn_taglink", f"WITH {MEM}, {RECENT10}, {TAGGED} SELECT new_id, other_id FROM tagged")
def _(t):
    recent = ingest.newest(t.memories, 10, "tags").select(F.col("id").alias("other_id"), "project_id", F.col("tags").alias("theirs"))
    low = lambda c: F.transform(c, F.lower)
    pairs = t.memories.select(F.col("id").alias("new_id"), "project_id", "tags").join(recent, "project_id").where("new_id <> other_id")
    return pairs.where(F.arrays_overlap(low(F.col("tags")), low(F.col("theirs")))).select("new_id", "other_id")


@query("set_overlap", f"WITH {MEM}, {RECENT10}, {TAGGED} SELECT new_id, count(*) AS n FROM tagged GROUP BY 1")
def _(t):
    recent = ingest.newest(t.memories, 10, "tags").select(F.col("id").alias("other_id"), "project_id", F.col("tags").alias("theirs"))
    low = lambda c: F.transform(c, F.lower)
    pairs = t.memories.select(F.col("id").alias("new_id"), "project_id", "tags").join(recent, "project_id").where("new_id <> other_id")
    return pairs.where(F.arrays_overlap(low(F.col("tags")), low(F.col("theirs")))).groupBy("new_id").agg(F.count(F.lit(1)).alias("n"))


def asked_again(t):
    """The query set of the write path: memories with text, project and vector whose id, read as a number, is divisible by 100."""
    known = t.kept.where("project_id is not null and content is not null and type is not null").where(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint") % 100 == 0)
    return known.join(t.embeddings.select(F.col("memory_id").alias("id"), "embedding"), "id")


FRESH = """fresh AS (SELECT mem.*, emb.embedding FROM mem JOIN emb ON emb.memory_id = mem.id
  WHERE mem.project_id IS NOT NULL AND content IS NOT NULL AND type IS NOT NULL AND ('0x' || id[1:8])::BIGINT % 100 = 0)"""
NEAR = f"""near AS (SELECT f.id AS new_id, e.memory_id AS other_id, {COSINE.format(a='a.embedding', b='e.embedding')} AS similarity FROM fresh f JOIN emb a ON a.memory_id = f.id JOIN emb e ON e.project_id = f.project_id AND e.memory_id <> f.id
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY round(similarity, 9) DESC, e.memory_id) <= 10)"""
FLOOR = "fl AS (SELECT new_id, CASE WHEN count(*) >= 3 THEN avg(similarity) + stddev_pop(similarity) ELSE avg(similarity) END AS floor FROM near GROUP BY 1)"


@query("agg_stats_floor", f"WITH {MEM}, {EMB}, {FRESH}, {NEAR}, {FLOOR} SELECT new_id, round(floor, 6)::DOUBLE AS floor FROM fl")
def _(t):
    near = ingest.vector_neighbours(asked_again(t), t.embeddings, DIM)
    s = near.groupBy("new_id").agg(F.avg("similarity").alias("m"), F.stddev_pop("similarity").alias("d"), F.count(F.lit(1)).alias("n"))
    return s.select("new_id", F.round(F.when(F.col("n") >= 3, F.col("m") + F.col("d")).otherwise(F.col("m")), 6).alias("floor"))


for _name in ("op_autolink", "top_relates"):

    @query(_name, f"""WITH {MEM}, {EMB}, {FRESH}, {NEAR}, {FLOOR}, {RECENT10}, {TAGGED}, both_links AS (
  SELECT new_id, other_id, max(weight) AS weight FROM (
    SELECT new_id, other_id, 0.5 AS weight FROM tagged WHERE new_id IN (SELECT id FROM fresh)
    UNION ALL SELECT near.new_id, other_id, similarity FROM near JOIN fl ON fl.new_id = near.new_id WHERE round(similarity, 9) >= round(floor, 9)) GROUP BY 1, 2)
SELECT new_id AS from_id, other_id AS to_id, round(weight, 6)::DOUBLE AS weight FROM both_links QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(weight, 9) DESC, other_id) <= 5""")
    def _(t):
        new = asked_again(t)
        near = ingest.vector_neighbours(new, t.embeddings, DIM)
        return ingest.autolinks(new, t.memories, near).select("from_id", "to_id", F.round("weight", 6).alias("weight"))


def offered(t):
    """The query set as new rows: told again, with more, with less, and denied, by turns."""
    turn = F.conv(F.substring("id", 10, 2), 16, 10).cast("bigint") % 4
    less = F.regexp_replace("content", r"\s+\S+\s*\z", "")
    content = F.when(turn == 0, F.col("content")).when(turn == 1, F.concat("content", F.lit(" as agreed"))).when(turn == 2, less).otherwise(F.concat(F.lit("We no longer keep this: "), "content"))
    return asked_again(t).withColumns({"content": content, "id": F.concat(F.lit("new-"), "id")})


TOKENS = sql_tokens("content")
OFFERED = rf"""off AS (SELECT 'new-' || id AS id, type, project_id, tags, created_at, access_count, embedding, CASE ('0x' || id[10:11])::BIGINT % 4 WHEN 0 THEN content WHEN 1 THEN content || ' as agreed'
    WHEN 2 THEN regexp_replace(content, '\s+\S+\s*\z', '') ELSE 'We no longer keep this: ' || content END AS content FROM fresh),
hashes AS (SELECT id, project_id, type, substring(sha256(array_to_string({TOKENS}, ' ')), 1, 32) AS hash FROM mem WHERE content IS NOT NULL AND len({TOKENS}) > 0 AND project_id IS NOT NULL AND type IS NOT NULL),
known_ AS (SELECT project_id, hash, type, min(id) AS existing_id FROM hashes GROUP BY 1, 2, 3),
judged AS (SELECT off.*, existing_id FROM off LEFT JOIN known_ k ON k.project_id = off.project_id AND k.type = off.type AND k.hash = substring(sha256(array_to_string({TOKENS}, ' ')), 1, 32)),
unknown_ AS (SELECT * FROM judged WHERE existing_id IS NULL),
vecs AS (SELECT memory_id, project_id, embedding FROM emb UNION ALL SELECT id, project_id, embedding FROM unknown_),
near_u AS (SELECT u.id AS new_id, v.memory_id AS other_id, {COSINE.format(a='u.embedding', b='v.embedding')} AS similarity FROM unknown_ u JOIN vecs v ON v.project_id = u.project_id AND v.memory_id <> u.id
  QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY round(similarity, 9) DESC, v.memory_id) <= 10),
cmp_ AS (SELECT new_id, m.id AS old_id, similarity, {sql_tokens('u.content')} AS a, {sql_tokens('m.content')} AS b FROM near_u JOIN unknown_ u ON u.id = new_id JOIN mem m ON m.id = other_id AND m.type = u.type WHERE m.content IS NOT NULL),
verdicts AS (SELECT new_id, old_id, similarity, {VERDICT} AS verdict FROM cmp_),
folded AS (SELECT new_id, old_id, verdict FROM verdicts WHERE verdict <> 'distinct' QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(similarity, 9) DESC, old_id) = 1)"""


@query("jn_fold", f"WITH {MEM}, {EMB}, {FRESH}, {OFFERED} SELECT verdict, count(*) AS n FROM verdicts GROUP BY 1")
def _(t):
    """Verdicts over all neighbours of the offered rows that are new."""
    new = memories.duplicates_by_hash(offered(t), t.kept).where("existing_id is null").drop("existing_id")
    new = stored(new, "offered")
    vectors = t.embeddings.unionByName(new.select(F.col("id").alias("memory_id"), "project_id", "embedding"))
    near = ingest.vector_neighbours(new, vectors, DIM)
    old = t.kept.where("content is not null").select(F.col("id").alias("other_id"), F.col("content").alias("old"), F.col("type").alias("old_type"))
    both = near.join(old, "other_id").join(new.select(F.col("id").alias("new_id"), "content", "type"), "new_id").where("type = old_type")
    verdict = X.subsumes(X.content_tokens(F.col("content")), X.content_tokens(F.col("old")))
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("op_fold_store", f"WITH {MEM}, {EMB}, {FRESH}, {OFFERED} SELECT new_id, old_id, verdict FROM folded")
def _(t):
    """What the offered rows that are new are folded into."""
    new = memories.duplicates_by_hash(offered(t), t.kept).where("existing_id is null").drop("existing_id")
    new = stored(new, "offered")
    vectors = t.embeddings.unionByName(new.select(F.col("id").alias("memory_id"), "project_id", "embedding"))
    return ingest.folds(new, t.kept, ingest.vector_neighbours(new, vectors, DIM))


def conversation_rows(t):
    docs = t.raw("documents").where("doc_kind = 'transcript' and text is not null")
    return docs.select(F.col("doc_id").alias("conversation_id"), "text")


@query("op_rule_extract")
def _(t):
    return extract.rule_extract(conversation_rows(t)).select("conversation_id", "seq", "content", "type", F.array_join("tags", ",").alias("tags"))


for _name in ("op_fold_batch", "agg_fold"):

    @query(_name)
    def _(t):
        return extract.fold_redundant(extract.rule_extract(conversation_rows(t))).select("conversation_id", "seq", "content", "type", "folded")


@query("op_extract")
def _(t):
    rows = extract.fold_redundant(extract.rule_extract(conversation_rows(t)))
    return extract.to_memories(rows, "documents", t.now).select("id", "content", "type", "content_hash")


STORED = f"""again AS (SELECT id AS new_id, existing_id AS old_id, 'equivalent' AS verdict FROM judged WHERE existing_id IS NOT NULL UNION ALL SELECT new_id, old_id, verdict FROM folded),
kept AS (SELECT * FROM unknown_ WHERE id NOT IN (SELECT new_id FROM again)),
reads_ AS (SELECT old_id, count(*) AS n, min(off.content) FILTER (verdict = 'new_subsumes_old') AS better FROM again JOIN off ON off.id = new_id GROUP BY 1),
after_ AS (
  SELECT mem.id, coalesce(better, content) AS content, type, project_id, tags, created_at, access_count + coalesce(n, 0) AS access_count FROM mem LEFT JOIN reads_ ON old_id = mem.id
  UNION ALL SELECT id, content, type, project_id, tags, created_at, access_count FROM kept),
sem AS (SELECT id, project_id, created_at, {sql_features('content', 'tags')} AS f FROM after_ WHERE type = 'semantic' AND content IS NOT NULL AND project_id IS NOT NULL),
last50 AS (SELECT * FROM sem QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 50),
con AS (SELECT a.id AS new_id, b.id AS old_id, {sql_contradiction('a.f', 'b.f')} AS c FROM sem a JOIN last50 b ON b.project_id = a.project_id AND b.id <> a.id WHERE a.id IN (SELECT id FROM kept)),
sup AS (SELECT new_id, old_id FROM con WHERE c.confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY c.confidence DESC, old_id) <= 5),
near_k AS (SELECT n.* FROM near_u n WHERE new_id IN (SELECT id FROM kept) AND other_id IN (SELECT id FROM after_) AND (new_id, other_id) NOT IN (SELECT new_id, old_id FROM sup)),
fl AS (SELECT new_id, CASE WHEN count(*) >= 3 THEN avg(similarity) + stddev_pop(similarity) ELSE avg(similarity) END AS floor FROM near_k GROUP BY 1),
last10 AS (SELECT id, project_id, tags FROM after_ QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 10),
tagged AS (SELECT k.id AS new_id, r.id AS other_id FROM kept k JOIN last10 r ON r.project_id = k.project_id AND r.id <> k.id
  WHERE len(list_intersect(list_transform(k.tags, lambda x: lower(x)), list_transform(r.tags, lambda x: lower(x)))) > 0),
both_links AS (SELECT new_id, other_id, max(weight) AS weight FROM (
    SELECT new_id, other_id, 0.5 AS weight FROM tagged WHERE (new_id, other_id) NOT IN (SELECT new_id, old_id FROM sup)
    UNION ALL SELECT n.new_id, other_id, similarity FROM near_k n JOIN fl ON fl.new_id = n.new_id WHERE round(similarity, 9) >= round(floor, 9)) GROUP BY 1, 2),
rel AS (SELECT new_id, other_id FROM both_links QUALIFY row_number() OVER (PARTITION BY new_id ORDER BY round(weight, 9) DESC, other_id) <= 5)"""


@query(
    "op_store",
    f"""WITH {MEM}, {EMB}, {FRESH}, {OFFERED}, {STORED}
SELECT 'memories' AS what, coalesce(type, '') AS name, count(*) AS n FROM after_ GROUP BY 2 UNION ALL SELECT 'reads', '', sum(access_count)::BIGINT FROM after_
UNION ALL SELECT 'verdict', verdict, count(*) FROM again GROUP BY 2 UNION ALL SELECT 'edges', 'supersedes', count(*) FROM sup UNION ALL SELECT 'edges', 'relates_to', count(*) FROM rel""",
)
def _(t):
    """The offered rows stored: known, folded either way, or new with their edges."""
    emb = t.embeddings.withColumn("created_at", t.now)
    made = ingest.changes(offered(t), t.kept, emb, DIM, t.now)
    after = t.kept.join(made["memories"].select("id"), "id", "left_anti").unionByName(made["memories"].select(*t.kept.columns))
    n = F.count(F.lit(1)).alias("n")
    parts = [
        after.groupBy(F.coalesce("type", F.lit("")).alias("name")).agg(n).select(F.lit("memories").alias("what"), "name", "n"),
        after.agg(F.sum("access_count").alias("n")).select(F.lit("reads").alias("what"), F.lit("").alias("name"), "n"),
        made["folded"].groupBy(F.col("verdict").alias("name")).agg(n).select(F.lit("verdict").alias("what"), "name", "n"),
        # Kinds without an edge are counted too.
        made["edges"].select(F.col("relationship").alias("name"), F.lit(1).alias("one")).unionByName(t.spark.createDataFrame([("supersedes", 0), ("relates_to", 0)], "name string, one int"))
        .groupBy("name").agg(F.sum("one").alias("n")).select(F.lit("edges").alias("what"), "name", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sets -------------------------------------------------------------------------------------------


PAIRS = "prs AS (SELECT DISTINCT a.id AS new_id, b.id AS old_id, a.content AS new, b.content AS old, a.tags AS nt, b.tags AS ot FROM edg e JOIN mem a ON a.id = e.from_id JOIN mem b ON b.id = e.to_id WHERE a.content IS NOT NULL AND b.content IS NOT NULL AND a.id <> b.id)"


@query("set_jaccard", f"WITH {MEM}, {EDG}, {PAIRS}, w AS (SELECT new_id, old_id, {sig('new')} AS a, {sig('old')} AS b FROM prs) SELECT new_id, old_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6)::DOUBLE AS s FROM w")
def _(t):
    from loci.plans.texts import pairs

    return pairs(t).select("new_id", "old_id", F.round(X.jaccard(X.significant_words(F.col("new")), X.significant_words(F.col("old"))), 6).alias("s"))


@query("set_tagratio", f"""WITH {MEM}, {EDG}, {PAIRS} SELECT new_id, old_id, round(CASE WHEN least(len(nt), len(ot)) = 0 THEN 0
  ELSE len(list_filter(list_transform(ot, lambda x: lower(x)), lambda y: list_contains(list_transform(nt, lambda x: lower(x)), y))) / least(len(nt), len(ot)) END, 6)::DOUBLE AS s FROM prs""")
def _(t):
    from loci.plans.texts import pairs

    return pairs(t).select("new_id", "old_id", F.round(X.tag_ratio(F.col("new_tags"), F.col("old_tags")), 6).cast("double").alias("s"))


@query(
    "set_tags_union",
    f"""WITH {MEM}, {EDG}, {PAIRS}, l AS (SELECT new_id, old_id, list_filter(list_concat(nt, ot), lambda x: trim(x) <> '') AS g FROM prs)
SELECT new_id, old_id, CASE WHEN len(g) > 0 THEN array_to_string(list_filter(g, lambda x, i: len(list_filter(g[1:i - 1], lambda y: lower(y) = lower(x))) = 0), ',') ELSE '' END AS tags FROM l""",
)
def _(t):
    from loci.plans.texts import pairs

    return pairs(t).select("new_id", "old_id", F.coalesce(F.array_join(X.tags_union(F.col("new_tags"), F.col("old_tags")), ","), F.lit("")).alias("tags"))


# --- aggregations -------------------------------------------------------------------------------------


@query("agg_counts", f"WITH {MEM}, {EDG} SELECT 'memory' AS kind, coalesce(type, '') AS name, count(*) AS n FROM mem GROUP BY 2 UNION ALL SELECT 'edge', relationship, count(*) FROM edg GROUP BY 2")
def _(t):
    a = t.memories.groupBy(F.coalesce("type", F.lit("")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("memory").alias("kind"), "name", "n")
    b = t.edges.groupBy(F.col("relationship").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    return a.unionByName(b)


@query("agg_hist", "SELECT le::DOUBLE AS le, (SELECT count(*) FROM events WHERE value <= le)::BIGINT AS n FROM (VALUES (10.0::DOUBLE), (25.0), (50.0), (100.0), ('inf'::DOUBLE)) v(le)")
def _(t):
    return evaluate.histogram(t.raw("events"), "value", [10.0, 25.0, 50.0, 100.0])


@query("agg_percentile", "SELECT event_type, 0.95::DOUBLE AS share, (list_sort(list(value)))[ceil(0.95::DOUBLE * count(value))::INT] AS percentile FROM events GROUP BY 1")
def _(t):
    return evaluate.nearest_rank(t.raw("events"), "event_type", "value", 0.95)


#: Every semantic memory is there a second time under another id, as after two imports of one source.
TWICE = "one_ AS (SELECT * FROM mem), mem2 AS (SELECT * FROM one_ UNION ALL SELECT * REPLACE ('z-' || id AS id) FROM one_ WHERE type = 'semantic')"
GROUPS2 = "g AS (SELECT project_id, content, count(*) AS n, arg_max(id, (created_at, id)) AS newest FROM mem2 WHERE type = 'semantic' AND content IS NOT NULL AND project_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"
GROUPS = "g AS (SELECT project_id, content, count(*) AS n, arg_max(id, (created_at, id)) AS newest FROM mem WHERE type = 'semantic' AND content IS NOT NULL AND project_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"
MERGE_SQL = f"WITH {MEM}, {TWICE}, {GROUPS2} SELECT g.newest AS from_id, m.id AS to_id FROM g JOIN mem2 m ON m.project_id = g.project_id AND m.content = g.content AND m.type = 'semantic' AND m.id <> g.newest"


def told_twice(t):
    return t.memories.unionByName(t.memories.where("type = 'semantic'").withColumn("id", F.concat(F.lit("z-"), "id")))


@query("op_merge_phase", MERGE_SQL)
def _(t):
    return maintain.merges(told_twice(t)).select("from_id", "to_id")


@query("agg_dupgroups", f"WITH {MEM}, {TWICE}, {GROUPS2} SELECT project_id, md5(content) AS digest, n, newest FROM g")
def _(t):
    rows = told_twice(t).where("type = 'semantic' and content is not null and project_id is not null")
    g = rows.groupBy("project_id", "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("created_at", "id"))["id"].alias("newest")).where("n > 1")
    return g.select("project_id", F.md5("content").alias("digest"), "n", "newest")


@query("win_newest", f"WITH {MEM}, {TWICE}, {GROUPS2} SELECT newest, count(*) AS merged FROM g JOIN mem2 m ON m.project_id = g.project_id AND m.content = g.content AND m.type = 'semantic' AND m.id <> g.newest GROUP BY 1")
def _(t):
    return maintain.merges(told_twice(t)).groupBy(F.col("from_id").alias("newest")).agg(F.count(F.lit(1)).alias("merged"))


@query("op_decay_phase", f"WITH {MEM} SELECT id, round({DECAY}, 6)::DOUBLE AS decay_score FROM mem")
def _(t):
    return maintain.decay_phase(t.memories, t.now).select("id", F.round("decay_score", 6).alias("decay_score"))


AFTER = f"aged AS (SELECT *, {DECAY} AS fresh FROM mem), gone AS (SELECT id FROM aged WHERE fresh < 0.1 AND access_count = 0 AND ({HOURS}) / 24 > 30)"


@query("op_prune_phase", f"WITH {MEM}, {AFTER} SELECT id FROM gone")
def _(t):
    return maintain.stale(maintain.decay_phase(t.memories, t.now), t.now).select("id")


for _name in ("op_consolidate", "api_consolidate", "agg_consol_result"):

    @query(_name, f"""WITH {MEM}, {EDG}, {GROUPS}, {AFTER}, mg AS (SELECT g.newest AS from_id, m.id AS to_id FROM g JOIN mem m ON m.project_id = g.project_id AND m.content = g.content AND m.type = 'semantic' AND m.id <> g.newest)
SELECT 'merged' AS phase, count(*) AS n FROM mg WHERE (from_id, to_id) NOT IN (SELECT from_id, to_id FROM edg WHERE relationship = 'supersedes')
UNION ALL SELECT 'decayed', count(*) FROM aged WHERE abs(fresh - decay_score) > 1e-9 UNION ALL SELECT 'pruned', count(*) FROM gone""")
    def _(t):
        return maintain.consolidation_report({"memories": t.memories, "edges": t.edges}, t.now)


PROFILE = f"""recent AS (SELECT * FROM mem WHERE project_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) <= 200),
facts AS (SELECT project_id, CASE WHEN type IN ('semantic', 'procedural') THEN 'static' WHEN type = 'episodic' AND created_at > {SQL_NOW} - INTERVAL 60 DAY THEN 'dynamic' END AS section, id, type, decay_score FROM recent)"""
for _name in ("op_profile", "api_profile"):

    @query(_name, f"WITH {MEM}, {PROFILE} SELECT project_id, section, id, type, decay_score::DOUBLE AS confidence FROM facts WHERE section IS NOT NULL")
    def _(t):
        return profile.profiles(t.memories, t.now, 0, 60).select("project_id", "section", "id", "type", "confidence")


@query("api_session", "SELECT user_id, count(*) AS events, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def _(t):
    runs = profile.sessions_by_gap(t.raw("events"), "user_id", "ts")
    return runs.groupBy("user_id").agg(F.sum("events").alias("events"), F.min(F.unix_micros("started_at")).alias("first_us"), F.max(F.unix_micros("ended_at")).alias("last_us"))


@query("api_health", f"WITH {MEM}, {EDG}, {MEN} SELECT (SELECT count(*) FROM mem) + (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM edg) + (SELECT count(*) FROM men) AS edges")
def _(t):
    return graph.counts(t.memories, t.entities, t.edges, t.mentions)


@query("win_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(t):
    return memories.latest(t.raw("events").select("user_id", "event_id", "ts"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("win_rolling14", "SELECT id, customer_id, (SELECT count(*) FROM world_invoices b WHERE b.customer_id = a.customer_id AND date_diff('day', b.issued_date, a.issued_date) BETWEEN 0 AND 13) AS n FROM world_invoices a WHERE customer_id IS NOT NULL AND issued_date IS NOT NULL")
def _(t):
    rows = t.raw("world_invoices", "id", "customer_id", "issued_date").where("customer_id is not null and issued_date is not null")
    # Counts per customer and day first, so that a window row is a day and not an invoice.
    days = rows.groupBy("customer_id", F.unix_date("issued_date").alias("day")).agg(F.count(F.lit(1)).alias("m"))
    last = Window.partitionBy("customer_id").orderBy("day").rangeBetween(-13, 0)
    days = days.select("customer_id", "day", F.sum("m").over(last).alias("n"))
    return rows.withColumn("day", F.unix_date("issued_date")).join(days, ["customer_id", "day"]).select("id", "customer_id", "n")


# --- evaluation: the question of a held-out item should find documents that hold its passage's words ---------


def evaluation(t):
    """(ranked, sources, evidence, questions): candidates of each trace by vector, entity-backed ones as evidence."""
    c = t.raw("trace_candidates").groupBy("trace_id", "memory_id").agg(F.max("vector").alias("v"), F.max("entity").alias("e"))
    c = c.where("v is null or not isnan(v)")
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("v"), "memory_id"))
    ranked = c.select(F.col("trace_id").alias("question_id"), rank.alias("rank"), F.col("memory_id").alias("id"))
    sources = c.select(F.col("memory_id").alias("id"), F.col("memory_id").alias("evidence_key")).distinct()
    evidence = c.where("e >= 0.5 and not isnan(e)").select(F.col("trace_id").alias("question_id"), F.col("memory_id").alias("evidence_key"))
    questions = c.select(F.col("trace_id").alias("question_id")).distinct().withColumn("category", F.when(F.col("question_id") % 5 == 0, "adversarial").otherwise("single-hop"))
    return ranked, sources, evidence, questions


EVAL = """c AS (SELECT trace_id, memory_id, max(vector) AS v, max(entity) AS e FROM trace_candidates GROUP BY 1, 2),
ok AS (SELECT * FROM c WHERE v IS NULL OR NOT isnan(v)),
rk AS (SELECT trace_id, memory_id, e, row_number() OVER (PARTITION BY trace_id ORDER BY v DESC NULLS LAST, memory_id) AS r FROM ok),
ev AS (SELECT trace_id AS question_id, memory_id AS evidence_key, r FROM rk WHERE e >= 0.5 AND NOT isnan(e)),
sc AS (SELECT question_id, count(*) AS evidence, max(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) AS recall, min(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) AS full_,
  CASE WHEN min(r) <= 10 THEN 1.0 / min(r) ELSE 0.0 END AS mrr, sum(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
  FROM ev GROUP BY 1)"""
for _name in ("win_firstrank", "jn_eval"):

    @query(_name, f"WITH {EVAL} SELECT question_id, evidence_key, r AS rank FROM ev")
    def _(t):
        ranked, sources, evidence, _ = evaluation(t)
        return evaluate.first_ranks(ranked, sources, evidence).select("question_id", "evidence_key", F.col("rank").cast("bigint").alias("rank"))


@query("op_score_question", f"WITH {EVAL} SELECT question_id, evidence, hit::DOUBLE AS hit, round(recall, 6)::DOUBLE AS recall, full_::DOUBLE AS full_hit, round(mrr, 6)::DOUBLE AS mrr, round(ndcg, 6)::DOUBLE AS ndcg FROM sc")
def _(t):
    ranked, sources, evidence, _ = evaluation(t)
    s = evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence))
    return s.select("question_id", "evidence", "hit", F.round("recall", 6).alias("recall"), F.col("full").alias("full_hit"), F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query("m_mrr", f"WITH {EVAL} SELECT question_id, round(mrr, 6)::DOUBLE AS mrr FROM sc")
def _(t):
    ranked, sources, evidence, _ = evaluation(t)
    return evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence)).select("question_id", F.round("mrr", 6).alias("mrr"))


@query("m_ndcg", f"WITH {EVAL} SELECT question_id, round(ndcg, 6)::DOUBLE AS ndcg FROM sc")
def _(t):
    ranked, sources, evidence, _ = evaluation(t)
    return evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence)).select("question_id", F.round("ndcg", 6).alias("ndcg"))


for _name in ("agg_metrics", "agg_bycat", "api_eval"):

    @query(_name, f"""WITH {EVAL}, q AS (SELECT DISTINCT trace_id AS question_id, CASE WHEN trace_id % 5 = 0 THEN 'adversarial' ELSE 'single-hop' END AS category FROM ok),
x AS (SELECT category, question_id FROM q UNION ALL SELECT 'all', question_id FROM q UNION ALL SELECT 'answerable', question_id FROM q WHERE category <> 'adversarial')
SELECT category, count(evidence)::BIGINT AS n, (count(*) - count(evidence))::BIGINT AS unscorable, round(avg(hit), 6)::DOUBLE AS hit, round(avg(recall), 6)::DOUBLE AS recall, round(avg(mrr), 6)::DOUBLE AS mrr, round(avg(ndcg), 6)::DOUBLE AS ndcg
FROM x LEFT JOIN sc ON sc.question_id = x.question_id GROUP BY 1""")
    def _(t):
        ranked, sources, evidence, questions = evaluation(t)
        m = evaluate.aggregate(evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence)), questions)
        return m.select("category", "n", "unscorable", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])


@query("op_trace", f"WITH {EVAL} SELECT question_id, evidence_key AS id, r AS vector_rank, r AS final_rank FROM ev")
def _(t):
    ranked, _, evidence, _ = evaluation(t)
    docs = evidence.select("question_id", F.col("evidence_key").alias("id"))
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return evaluate.trace(ranked, {"vector": ranked}, docs).select("question_id", "id", long("vector_rank"), long("final_rank"))


@query(
    "sink_report",
    f"""WITH {EVAL}, q AS (SELECT DISTINCT trace_id AS question_id, CASE WHEN trace_id % 5 = 0 THEN 'adversarial' ELSE 'single-hop' END AS category FROM ok),
x AS (SELECT category, question_id FROM q UNION ALL SELECT 'all', question_id FROM q UNION ALL SELECT 'answerable', question_id FROM q WHERE category <> 'adversarial'),
m AS (SELECT category, count(evidence) AS n, avg(hit) AS hit, avg(recall) AS recall, avg(full_) AS full_, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM x LEFT JOIN sc ON sc.question_id = x.question_id GROUP BY 1)
SELECT rpad(category, 12, ' ') || '  ' || lpad(n::VARCHAR, 5, ' ') || '  ' || format('{{:.3f}}', hit) || '  ' || format('{{:.3f}}', recall) || '  ' || format('{{:.3f}}', full_) || '  ' || format('{{:.3f}}', mrr) || '  ' || format('{{:.3f}}', ndcg) AS line FROM m""",
)
def _(t):
    ranked, sources, evidence, questions = evaluation(t)
    m = evaluate.aggregate(evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence)), questions)
    return m.select(evaluate.report_lines(m).alias("line"))


@query(
    "op_align_labels",
    f"""WITH a AS (SELECT item_id AS id, conversation, {sql_tokens('question')} AS w FROM eval_items WHERE question IS NOT NULL), b AS (SELECT item_id::VARCHAR AS turn_key, conversation, {sql_tokens('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
s AS (SELECT id, turn_key, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / len(list_distinct(a.w)) AS share FROM a JOIN b USING (conversation))
SELECT id, turn_key, round(share, 6)::DOUBLE AS share FROM s WHERE share > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, turn_key) = 1""",
)
def _(t):
    items = t.raw("eval_items")
    turns = items.select(F.col("item_id").cast("string").alias("turn_key"), "conversation", X.content_tokens(F.col("passage")).alias("words"))
    asked = items.select(F.col("item_id").alias("id"), "conversation", X.content_tokens(F.col("question")).alias("words"))
    return evaluate.aligned(asked, turns).select("id", "turn_key", F.round("share", 6).alias("share"))

