"""What is left of the inventory: limits, clocks, notes, structured answers, fixtures, corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.config import pools, top_k
from loci.functions import notes as N
from loci.operators import graph, memories
from loci.plans.base import EDG, MEM, MEN, ORACLES, QUERIES, SQL_NOW, query
from loci.sources import conversations, vectors

_LIMITS = "WITH k AS (SELECT unnest(range(-3, 251)) AS asked), t AS (SELECT asked, CASE WHEN asked <= 0 THEN 5 WHEN asked > 200 THEN 200 ELSE asked END AS k FROM k)"


def limits(t):
    rows = [(k, top_k(k), *pools(top_k(k))) for k in range(-3, 251)]
    return t.spark.createDataFrame(rows, "asked bigint, k bigint, kw bigint, vec bigint, ent bigint")


@query("lim_topk", f"{_LIMITS} SELECT asked, k FROM t")
def _(t):
    return limits(t).select("asked", "k")


@query("pool_kw", f"{_LIMITS} SELECT asked, least(10 * k, 500) AS kw FROM t")
def _(t):
    return limits(t).select("asked", "kw")


@query("pool_vec", f"{_LIMITS} SELECT asked, least(10 * k, 200) AS vec FROM t")
def _(t):
    return limits(t).select("asked", "vec")


@query("pool_ent", f"{_LIMITS} SELECT asked, least(5 * k, 100) AS ent FROM t")
def _(t):
    return limits(t).select("asked", "ent")


@query("lim_scan", f"WITH {MEM} SELECT id FROM mem WHERE type = 'semantic' ORDER BY created_at DESC, id LIMIT 100")
def _(t):
    return memories.listing(t.memories, None, ["semantic"], (), 100).select("id")


@query("lim_entities", f"WITH {MEN}, r AS (SELECT memory_id, normalized_name, row_number() OVER (PARTITION BY memory_id ORDER BY normalized_name) AS n FROM men) SELECT memory_id, string_agg(normalized_name, ',' ORDER BY normalized_name) AS names FROM r WHERE n <= 6 GROUP BY 1")
def _(t):
    return t.mentions.groupBy("memory_id").agg(F.array_join(F.slice(F.sort_array(F.collect_list("normalized_name")), 1, 6), ",").alias("names"))


@query("src_pool", "SELECT 'UTC' AS zone")
def _(t):
    return t.spark.range(1).select(F.current_timezone().alias("zone"))


@query("dt_now_utc", f"WITH {MEM} SELECT count(*) AS n FROM mem WHERE created_at <= {SQL_NOW}")
def _(t):
    return t.memories.where(F.col("created_at") <= t.now).agg(F.count(F.lit(1)).alias("n"))


@query("dt_cutoff", f"WITH {MEM} SELECT id, epoch_us({SQL_NOW} - to_days(access_count::INT)) AS cutoff_us FROM mem")
def _(t):
    return t.memories.select("id", F.unix_micros(t.now - F.make_dt_interval(F.col("access_count").cast("int"))).alias("cutoff_us"))


@query("dt_overdue", "SELECT id, date_diff('day', due_date, DATE '2026-10-01')::BIGINT AS days FROM world_invoices WHERE due_date IS NOT NULL")
def _(t):
    return t.raw("world_invoices").where("due_date is not null").select("id", F.datediff(F.lit("2026-10-01").cast("date"), "due_date").cast("bigint").alias("days"))


@query("m_entrel", "SELECT trace_id, memory_id, max(entity) * 0.5 AS s FROM trace_candidates WHERE entity IS NOT NULL AND NOT isnan(entity) GROUP BY 1, 2")
def _(t):
    return t.raw("trace_candidates").where("entity is not null and not isnan(entity)").groupBy("trace_id", "memory_id").agg((F.max("entity") * 0.5).alias("s"))


_KIND = """CASE WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: [\\w -]+ went to .+ about INV-') THEN 'contact'
  WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: .+ will pay INV-\\S+ by \\d{4}-\\d{2}-\\d{2}\\.$') THEN 'promise'
  WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: .+ paid INV-\\S+ in full') THEN 'payment' WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: .+ disputes INV-') THEN 'dispute'
  WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: .+ has not answered about INV-') THEN 'no_response'
  WHEN regexp_matches(content, '^\\d{4}-\\d{2}-\\d{2}: INV-\\S+ of .+ was handed to a human') THEN 'escalation' END"""


@query("txt_notes", f"""WITH {MEM}, n AS (SELECT id, content, {_KIND} AS kind FROM mem WHERE content IS NOT NULL)
SELECT id, kind, content[1:10] AS day, regexp_extract(content, 'INV-\\d{{4}}-\\d+') AS invoice,
  CASE WHEN regexp_extract(content, '\\(\\D{{0,3}}([\\d,]+)\\)', 1) <> '' THEN replace(regexp_extract(content, '\\(\\D{{0,3}}([\\d,]+)\\)', 1), ',', '')::BIGINT END AS amount
FROM n WHERE kind IS NOT NULL""")
def _(t):
    c = F.col("content")
    rows = t.memories.where("content is not null").select("id", N.note_kind(c).alias("kind"), N.note_day(c).cast("string").alias("day"), N.note_invoice(c).alias("invoice"), N.note_amount(c).alias("amount"))
    return rows.where("kind is not null")


@query("agg_report", f"WITH {MEM}, n AS (SELECT {_KIND} AS kind FROM mem WHERE content IS NOT NULL) SELECT kind, count(*) AS n FROM n WHERE kind IS NOT NULL GROUP BY 1")
def _(t):
    return t.memories.where("content is not null").select(N.note_kind(F.col("content")).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("txt_reply", f"""WITH {MEM} SELECT id, CASE WHEN regexp_extract(content, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') <> '' THEN try_cast(regexp_extract(content, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b') AS DATE)::VARCHAR END AS day,
  regexp_matches(lower(content), '\\b(dispute|disputing|incorrect|wrong)\\b') AS disputed FROM mem WHERE content IS NOT NULL""")
def _(t):
    c = F.col("content")
    return t.memories.where("content is not null").select("id", N.reply_date(c).cast("string").alias("day"), N.is_dispute(c).alias("disputed"))


_ANSWER = f"WITH {MEM} SELECT id, content, coalesce(type, 'semantic') AS type, len(tags)::BIGINT AS tags FROM mem WHERE content IS NOT NULL AND trim(content) <> ''"
for _name in ("js_llm", "conn_llm"):

    @query(_name, _ANSWER)
    def _(t):
        """Every memory written as a model's fenced answer and read again."""
        body = F.to_json(F.array(F.struct("content", F.upper("type").alias("type"), "tags")))
        rows = t.memories.where("content is not null").select("id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))
        out = rows.select("id", F.explode(N.parsed_memories(F.col("answer"))).alias("m"))
        return out.select("id", "m.content", "m.type", F.size("m.tags").cast("bigint").alias("tags"))


@query("js_answer", "SELECT item_id, answer FROM eval_items")
def _(t):
    return t.raw("eval_items").select("item_id", N.answer_text(F.to_json(F.struct("answer"))).alias("answer"))


def fixture(t):
    """Vectors by the SHA-256 of their memory's text: smallest memory id of a text."""
    both = t.memories.where("content is not null").join(t.embeddings.select(F.col("memory_id").alias("id"), "embedding"), "id")
    return both.groupBy(F.unhex(F.sha2("content", 256)).alias("text_sha")).agg(F.min_by("embedding", "id").alias("embedding"))


@query("src_fixture", f"WITH {MEM}, u AS (SELECT DISTINCT memory_id FROM memory_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) SELECT DISTINCT sha256(content) AS text_sha FROM mem JOIN u ON u.memory_id = mem.id WHERE content IS NOT NULL")
def _(t):
    return fixture(t).select(F.lower(F.hex("text_sha")).alias("text_sha"))


@query("src_fixture_lookup", f"WITH {MEM}, u AS (SELECT DISTINCT memory_id FROM memory_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), f AS (SELECT DISTINCT content FROM mem JOIN u ON u.memory_id = mem.id WHERE content IS NOT NULL) SELECT id, mem.content IN (SELECT content FROM f) AS known FROM mem WHERE mem.content IS NOT NULL")
def _(t):
    rows = vectors.looked_up(t.memories.where("content is not null").select("id", F.col("content").alias("text")), fixture(t))
    return rows.select("id", F.col("embedding").isNotNull().alias("known"))


@query("src_snapshot", f"WITH {MEM}, {MEN} SELECT mem.id, string_agg(mem.project_id || '/' || normalized_name, ',' ORDER BY normalized_name) AS sources FROM mem JOIN men ON men.memory_id = mem.id WHERE mem.project_id IS NOT NULL AND normalized_name IS NOT NULL GROUP BY 1")
def _(t):
    snapshot = t.memories.where("project_id is not null").select("id", F.col("project_id").alias("conversation"))
    labels = t.mentions.where("normalized_name is not null").groupBy("memory_id").agg(F.sort_array(F.collect_list("normalized_name")).alias("dia_ids"))
    return conversations.extracted_corpus(snapshot, labels).where(F.size("sources") > 0).select("id", F.array_join("sources", ",").alias("sources"))


def questions(t):
    """The held-out items as a question table with evidence."""
    i = t.raw("eval_items")
    return i.select(F.concat("conversation", F.lit("-q"), F.col("item_id").cast("string")).alias("id"), "conversation", "category", "question", "answer")


@query("src_locomo", "SELECT conversation || '-q' || item_id::VARCHAR AS id, category, question FROM eval_items")
def _(t):
    return questions(t).select("id", "category", "question")


@query("src_pinned", "SELECT conversation || '-q' || item_id::VARCHAR AS id FROM eval_items WHERE category = 'single-hop'")
def _(t):
    pinned = questions(t).where("category = 'single-hop'").select("id")
    return questions(t).join(pinned, "id", "left_semi").select("id")


@query("api_connect", f"WITH {MEM}, {EDG} SELECT from_id, to_id, relationship, weight::DOUBLE AS weight FROM edg WHERE from_id IN (SELECT id FROM mem) AND to_id IN (SELECT id FROM mem)")
def _(t):
    """All valid edges connected once more with another weight: the older ones stay in effect."""
    known = t.memories.select("id")
    ok = t.edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*t.edges.columns)
    _, effective = graph.connect(ok.withColumn("weight", F.lit(0.123)), ok, t.memories)
    return effective.select("from_id", "to_id", "relationship", "weight")


for _new, _old in (("api_delete", "sink_delete"), ("api_store", "op_store"), ("api_extract", "op_extract"), ("lim_topics", "txt_topics")):
    QUERIES[_new] = QUERIES[_old]
    if _old in ORACLES:
        ORACLES[_new] = ORACLES[_old]

