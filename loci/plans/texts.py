"""Text, number and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import lists as L
from loci.functions import scoring as S
from loci.functions import text as X
from loci.functions import vector as V
from loci.functions.entities import entities, plausible
from loci.operators import extract
from loci.plans.base import ASKED, COSINE, EDG, EMB, MEM, SQL_NOW, query, quoted, sql_keywords, sql_split, sql_tokens
from loci.sources import conversations

HASH = f"substring(sha256(array_to_string({sql_tokens('content')}, ' ')), 1, 32)"
SIG = f"list_filter({sql_split('{}', L.TRIM_SIGNIFICANT)}, lambda w: strlen(w) > 1 AND w NOT IN ({quoted(L.SIGNIFICANT_STOP)}))"


def sig(column: str) -> str:
    return f"list_distinct({SIG.replace('{}', column)})"


def joined(c):
    return F.array_join(c, " ")


@query("txt_tokens", f"WITH {MEM} SELECT id, len({sql_tokens('content')})::BIGINT AS n, array_to_string({sql_tokens('content')}, ' ') AS tokens FROM mem WHERE content IS NOT NULL")
def _(t):
    w = X.content_tokens(F.col("content"))
    return t.memories.where("content is not null").select("id", F.size(w).cast("bigint").alias("n"), joined(w).alias("tokens"))


@query("txt_hash", f"WITH {MEM} SELECT id, CASE WHEN len({sql_tokens('content')}) = 0 THEN '' ELSE {HASH} END AS hash FROM mem WHERE content IS NOT NULL")
def _(t):
    return t.memories.where("content is not null").select("id", X.content_hash(F.col("content")).alias("hash"))


@query(
    "txt_norm_entity",
    r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(trim(lower(name)), '.,;:!?"''“”()[]{}'), '''s$', ''), '’s$', ''), '\s+', ' ', 'g')) AS normalized FROM entities""",
)
def _(t):
    return t.entities.select("id", X.normalize_entity(F.col("name")).alias("normalized"))


@query("txt_keywords", f"SELECT item_id, array_to_string({sql_keywords('question')}, ' ') AS keywords FROM eval_items")
def _(t):
    return t.raw("eval_items").select("item_id", joined(X.keywords(F.col("question"))).alias("keywords"))


_BOW = f"list_filter({sql_split('content', L.TRIM_EMBED)}, lambda w: strlen(w) >= 2 AND w NOT IN ({quoted(L.EMBED_STOP)}))"


@query("txt_bow_tokens", f"WITH {MEM} SELECT id, array_to_string({_BOW}, ' ') AS tokens FROM mem WHERE content IS NOT NULL")
def _(t):
    return t.memories.where("content is not null").select("id", joined(X.embedding_tokens(F.col("content"))).alias("tokens"))


@query(
    "txt_fnv",
    f"""WITH {MEM}, w AS (SELECT DISTINCT unnest({sql_tokens('content')}) AS token FROM mem WHERE content IS NOT NULL)
SELECT token, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, strlen(token) + 1), lambda i: ('0x' || substring(hex(encode(token)), 2 * i - 1, 2))::UBIGINT)),
  lambda h, b: (xor(h, b) * 16777619) & 4294967295::UBIGINT)::BIGINT AS fnv FROM w""",
)
def _(t):
    words = t.memories.where("content is not null").select(F.explode(X.content_tokens(F.col("content"))).alias("token")).distinct()
    return words.select("token", X.fnv1a32(F.col("token")).alias("fnv"))


_UTTER = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+([A-Z][A-Za-z0-9_]{0,28}: )', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda p: trim(p)), lambda p: p <> '')"


@query("txt_split_utt", f"SELECT doc_id, len({_UTTER})::BIGINT AS n, md5(array_to_string({_UTTER}, chr(10))) AS digest FROM documents WHERE text IS NOT NULL")
def _(t):
    u = X.utterances(F.col("text"))
    return t.raw("documents").where("text is not null").select("doc_id", F.size(u).cast("bigint").alias("n"), F.md5(F.array_join(u, "\n")).alias("digest"))


_STRIP = "CASE WHEN instr(line, ': ') > 1 AND strlen(substring(line, 1, instr(line, ': ') - 1)) < 30 THEN substring(line, instr(line, ': ') + 2) ELSE line END"


@query("txt_strip_speaker", f"WITH l AS (SELECT doc_id, unnest({_UTTER}) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(string_agg({_STRIP}, '' ORDER BY {_STRIP})) AS digest FROM l GROUP BY doc_id")
def _(t):
    lines = t.raw("documents").where("text is not null").select("doc_id", F.explode(X.utterances(F.col("text"))).alias("line"))
    # One document's lines at a time, ordered as bytes on both sides.
    return lines.groupBy("doc_id").agg(F.md5(F.array_join(F.sort_array(F.collect_list(X.strip_speaker(F.col("line")))), "")).alias("digest"))


def _rule_sql(text: str) -> tuple[str, str]:
    noise = f"(lower(trim({text})) IN ({quoted(L.NOISE)}) OR strlen({text}) < 15)"
    has = lambda marks: "(" + " OR ".join(f"contains(lower({text}), {quoted([m])})" for m in marks) + ")"
    kinds = " ".join(f"WHEN {has(m)} THEN '{k}'" for k, _, m in L.RULES)
    tags = " ".join(f"WHEN {has(m)} THEN {quoted([g]) if g else 'NULL'}" for _, g, m in L.RULES)
    return f"CASE WHEN {noise} THEN NULL {kinds} WHEN strlen({text}) > 30 THEN 'episodic' END", f"CASE WHEN {noise} THEN NULL {tags} END"


@query("txt_classify", "WITH {0} SELECT id, {1} AS kind, {2} AS tag FROM mem WHERE content IS NOT NULL".format(MEM, *_rule_sql("content")))
def _(t):
    c = X.classified(F.col("content"))
    return t.memories.where("content is not null").select("id", c["type"].alias("kind"), c["tag"].alias("tag"))


@query("txt_noise", f"WITH {MEM} SELECT id FROM mem WHERE content IS NOT NULL AND (lower(trim(content)) IN ({quoted(L.NOISE)}) OR strlen(content) < 15)")
def _(t):
    return t.memories.where("content is not null").where(X.is_noise(F.col("content"))).select("id")


_TOPIC = rf"""list_filter(list_transform(regexp_split_to_array(lower(content), '\s+'), lambda w: trim(w, '.,;:!?"''()[]{{}}/-')), lambda w: w IN ({quoted(L.TOPICS)}))"""


@query(
    "txt_topics",
    f"""WITH {MEM}, x AS (SELECT id, {_TOPIC} AS w FROM mem WHERE content IS NOT NULL)
SELECT id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:4], ' ') AS topics FROM x""",
)
def _(t):
    return t.memories.where("content is not null").select("id", joined(X.topics(F.col("content"))).alias("topics"))


@query("txt_entities")
def _(t):
    return t.memories.where("content is not null").select("id", entities(F.col("content")).alias("entities"))


_DATES, _COUNTS = quoted(L.TEMPORAL), quoted(L.NUMBER_WORDS)


@query(
    "txt_plausible",
    rf"""WITH {MEM}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(content, '[ \n]+')) AS name FROM mem WHERE content IS NOT NULL)
SELECT name, length(name) >= 2 AND strlen(name) <= 80 AND trim(lower(name), '.,;:!?"''') NOT IN ({_DATES})
  AND NOT (trim(lower(name), '.,;:!?%$') IN ({_COUNTS}) OR regexp_full_match(trim(lower(name), '.,;:!?%$'), '[0-9]*')) AND regexp_matches(name, '[A-Za-z]|[^\x00-\x7f]') AS ok
FROM w WHERE regexp_full_match(name, '[!-~]+')""",
)
def _(t):
    """Every different word of the memories as a name."""
    words = t.memories.where("content is not null").select(F.explode(F.split("content", "[ \n]+")).alias("name")).distinct().where(F.col("name").rlike("^[!-~]+$") & ~F.col("name").contains("\n"))
    return words.select("name", F.pandas_udf(lambda s: s.map(plausible), "boolean")("name").alias("ok"))


_SUB = """
pairs AS (
  SELECT a.id AS new_id, b.id AS old_id, a.content AS new, b.content AS old FROM edg e JOIN mem a ON a.id = e.from_id JOIN mem b ON b.id = e.to_id
  WHERE a.content IS NOT NULL AND b.content IS NOT NULL AND a.id <> b.id)"""


def pairs(t):
    """Memory pairs joined by an edge."""
    a = t.memories.where("content is not null").select(F.col("id").alias("new_id"), F.col("content").alias("new"), F.col("tags").alias("new_tags"))
    b = t.memories.where("content is not null").select(F.col("id").alias("old_id"), F.col("content").alias("old"), F.col("tags").alias("old_tags"))
    ends = t.edges.select(F.col("from_id").alias("new_id"), F.col("to_id").alias("old_id")).where("new_id <> old_id").distinct()
    return ends.join(a, "new_id").join(b, "old_id")


_STEP = "list_reduce(list_prepend(0, list_transform({outer}, lambda w: 0)), lambda k, z, i: CASE WHEN k < len({inner}) AND ({inner})[k + 1] = ({outer})[i - 1] THEN k + 1 ELSE k END)"


def _inside(inner: str, outer: str) -> str:
    return f"(len({inner}) = 0 OR ({_STEP.format(inner=inner, outer=outer)} = len({inner})))"


@query(
    "txt_subseq",
    f"""WITH {MEM}, {EDG}, {_SUB}, w AS (SELECT DISTINCT new_id, old_id, {sql_tokens('new')} AS a, {sql_tokens('old')} AS b FROM pairs)
SELECT new_id, old_id, {_inside('b', 'a')} AS inside FROM w""",
)
def _(t):
    inside = X.is_ordered_subsequence(X.content_tokens(F.col("old")), X.content_tokens(F.col("new")))
    return pairs(t).select("new_id", "old_id", inside.alias("inside"))


@query("txt_polarity", f"WITH {MEM} SELECT id FROM mem WHERE content IS NOT NULL AND len(list_filter({sql_tokens('content')}, lambda w: w IN ({quoted(L.POLARITY)}))) > 0")
def _(t):
    return t.memories.where("content is not null").where(X.has_polarity(X.content_tokens(F.col("content")))).select("id")


_POL = f"(len(list_filter({{}}, lambda w: w IN ({quoted(L.POLARITY)}))) > 0)"


#: What the token lists a (new) and b (old) say of each other.
VERDICT = f"""CASE WHEN len(a) < 3 OR len(b) < 3 OR {_POL.replace('{}', 'a')} <> {_POL.replace('{}', 'b')} THEN 'distinct' WHEN a = b THEN 'equivalent'
  WHEN {_inside('b', 'a')} THEN 'new_subsumes_old' WHEN {_inside('a', 'b')} THEN 'old_subsumes_new' ELSE 'distinct' END"""


@query(
    "txt_subsumes",
    f"""WITH {MEM}, {EDG}, {_SUB}, w AS (SELECT DISTINCT new_id, old_id, {sql_tokens('new')} AS a, {sql_tokens('old')} AS b FROM pairs)
SELECT new_id, old_id, CASE WHEN len(a) < 3 OR len(b) < 3 OR {_POL.replace('{}', 'a')} <> {_POL.replace('{}', 'b')} THEN 'distinct' WHEN a = b THEN 'equivalent'
  WHEN {_inside('b', 'a')} THEN 'new_subsumes_old' WHEN {_inside('a', 'b')} THEN 'old_subsumes_new' ELSE 'distinct' END AS verdict FROM w""",
)
def _(t):
    return pairs(t).select("new_id", "old_id", X.subsumes(X.content_tokens(F.col("new")), X.content_tokens(F.col("old"))).alias("verdict"))


@query("txt_sigwords", f"WITH {MEM} SELECT id, array_to_string(list_sort({sig('content')}), ' ') AS words FROM mem WHERE content IS NOT NULL")
def _(t):
    return t.memories.where("content is not null").select("id", joined(F.sort_array(X.significant_words(F.col("content")))).alias("words"))


_NONEG = f"array_to_string(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w NOT IN ({quoted(L.NEGATION_WORDS)})), ' ')"


@query("txt_strip_neg", f"WITH {MEM} SELECT id, md5({_NONEG}) AS digest FROM mem WHERE content IS NOT NULL")
def _(t):
    return t.memories.where("content is not null").select("id", F.md5(X.without_negation(F.col("content"))).alias("digest"))


def sql_features(content: str, tags: str) -> str:
    """What the contradiction rules need of one memory, as a struct."""
    words = lambda part: rf"""list_filter(list_transform(regexp_split_to_array(trim({part}), '\s+'), lambda w: trim(w, '.,;:!?"''()-')), lambda w: strlen(w) > 1)"""
    low = f"(' ' || lower({content}) || ' ')"
    before = f"list_filter({words(f'{low}[1:at - 1]')}, lambda w: w NOT IN ('the', 'a', 'an', 'our', 'my', 'this', 'we', 'i'))"
    after = words(f"{low}[at + length(verb) + 2:]")
    verbs = quoted(L.VERBS)
    one = before.replace("at - 1", f"position(' ' || v || ' ' IN {low}) - 1")
    two = after.replace("at + length(verb)", f"position(' ' || v || ' ' IN {low}) + length(v)")
    made = f"{{'verb': v, 'at': position(' ' || v || ' ' IN {low}), 'before': {one}, 'after': {two}}}"
    kept = f"list_filter(list_transform([{verbs}], lambda v: {made}), lambda t: t['at'] > 0 AND len(t['before']) > 0 AND len(t['after']) > 0)"
    triples = f"list_transform({kept}, lambda t: {{'verb': t['verb'], 'subject': array_to_string(t['before'][greatest(len(t['before']) - 2, 1):], ' '), 'object': t['after'][1:3]}})"
    negated = " OR ".join(f"contains(lower({content}), '{m.replace(chr(39), chr(39) * 2)}')" for m in L.NEGATION_MARKS)
    signals = f"list_filter([{quoted(L.REPLACEMENT_MARKS)}], lambda m: contains(lower({content}), m))"
    plain = SIG.format(f"array_to_string(list_filter(regexp_split_to_array(lower({content}), '\\s+'), lambda w: w NOT IN ({quoted(L.NEGATION_WORDS)})), ' ')")
    return (
        f"{{'words': list_distinct({SIG.format(content)}), 'plain': list_distinct({plain}), 'triples': {triples}, 'denied': ({negated}), 'signal': {signals}[1], "
        f"'tags': list_transform({tags}, lambda x: lower(x))}}"
    )


def sql_contradiction(a: str, b: str) -> str:
    """Struct (reason, confidence) of the first rule between two feature structs, or null."""
    jac = lambda k: f"(CASE WHEN len(list_distinct(list_concat({a}.{k}, {b}.{k}))) = 0 THEN 0 ELSE len(list_intersect({a}.{k}, {b}.{k})) / len(list_distinct(list_concat({a}.{k}, {b}.{k}))) END)"
    ratio = f"(CASE WHEN least(len({a}.tags), len({b}.tags)) = 0 THEN 0 ELSE len(list_filter({b}.tags, lambda y: list_contains({a}.tags, y))) / least(len({a}.tags), len({b}.tags)) END)"
    refine = "x['object'][1:least(len(x['object']), len(y['object']))] = y['object'][1:least(len(x['object']), len(y['object']))]"
    clash = (
        f"flatten(list_transform({a}.triples, lambda x: list_transform(list_filter({b}.triples, lambda y: x['verb'] = y['verb'] AND x['subject'] = y['subject'] AND x['object'] <> y['object'] AND NOT ({refine})), "
        "lambda y: x['subject'] || ' ' || x['verb'] || ': ' || array_to_string(x['object'], ' ') || ' vs ' || array_to_string(y['object'], ' '))))[1]"
    )
    return f"""CASE WHEN {a}.signal IS NOT NULL AND ({jac('words')} >= 0.15 OR {ratio} >= 0.3) THEN {{'reason': 'replacement signal: ' || {a}.signal, 'confidence': 0.9::DOUBLE}}
    WHEN {clash} IS NOT NULL THEN {{'reason': {clash}, 'confidence': 0.85::DOUBLE}}
    WHEN {jac('plain')} >= 0.4 AND {a}.denied <> {b}.denied THEN {{'reason': 'negation conflict with high similarity', 'confidence': 0.8::DOUBLE}}
    WHEN len({a}.tags) > 0 AND len({b}.tags) > 0 AND {ratio} >= 0.5 AND {jac('plain')} >= 0.3 AND {jac('plain')} < 0.8 THEN {{'reason': 'shared tags with divergent content', 'confidence': 0.5::DOUBLE}} END"""


@query(
    "txt_triples",
    f"""WITH {MEM}, f AS (SELECT id, unnest(({sql_features('content', 'tags')}).triples) AS r FROM mem WHERE content IS NOT NULL)
SELECT id, r.verb AS verb, r.subject AS subject, array_to_string(r.object, ' ') AS object FROM f""",
)
def _(t):
    return t.memories.where("content is not null").select("id", F.explode(X.triples(F.col("content"))).alias("r")).select("id", "r.verb", "r.subject", F.array_join("r.object", " ").alias("object"))


@query("txt_refines", f"""WITH {MEM}, {EDG}, {_SUB}, w AS (SELECT DISTINCT new_id, old_id, {sql_tokens('new')} AS a, {sql_tokens('old')} AS b FROM pairs)
SELECT new_id, old_id, a[1:least(len(a), len(b))] = b[1:least(len(a), len(b))] AS refines FROM w""")
def _(t):
    return pairs(t).select("new_id", "old_id", X.refines(X.content_tokens(F.col("new")), X.content_tokens(F.col("old"))).alias("refines"))


@query(
    "txt_contradict",
    f"""WITH {MEM}, {EDG}, feats AS (SELECT id, {sql_features('content', 'tags')} AS f FROM mem WHERE content IS NOT NULL),
ends AS (SELECT DISTINCT from_id AS new_id, to_id AS old_id FROM edg WHERE from_id <> to_id),
c AS (SELECT new_id, old_id, {sql_contradiction('a.f', 'b.f')} AS c FROM ends JOIN feats a ON a.id = new_id JOIN feats b ON b.id = old_id)
SELECT new_id, old_id, c.reason AS reason, c.confidence AS confidence FROM c WHERE c IS NOT NULL""",
)
def _(t):
    features = X.contradiction_features
    both = pairs(t).select("new_id", "old_id", features(F.col("new"), F.col("new_tags")).alias("a"), features(F.col("old"), F.col("old_tags")).alias("b"))
    return both.withColumn("c", X.contradiction(F.col("a"), F.col("b"))).where("c is not null").select("new_id", "old_id", "c.reason", "c.confidence")


_LEX = """(SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE avg(CASE WHEN list_contains(list_transform(tags, lambda g: lower(g)), k) THEN 1.0 WHEN contains(lower(content), k) THEN 0.75 ELSE 0.0 END) END
  FROM (SELECT DISTINCT unnest(ks) AS k))"""


@query("txt_lexrel", f"""WITH {MEM}, {EMB}, {ASKED}, q AS (SELECT query_id, list_distinct({sql_keywords('text')}) AS ks FROM asked),
x AS (SELECT q.query_id, mem.id, mem.content, mem.tags, unnest(q.ks) AS k FROM q JOIN mem ON mem.project_id = q.query_id WHERE mem.content IS NOT NULL)
SELECT query_id, id, round(avg(CASE WHEN list_contains(list_transform(tags, lambda g: lower(g)), k) THEN 1.0 WHEN contains(lower(content), k) THEN 0.75 ELSE 0.0 END), 6)::DOUBLE AS relevance
FROM x GROUP BY 1, 2""")
def _(t):
    q = t.asked.select("query_id", X.keywords(F.col("text")).alias("ks")).where(F.size("ks") > 0)
    rows = t.memories.where("content is not null").join(q, F.col("project_id") == F.col("query_id"))
    return rows.select("query_id", "id", F.round(X.lexical_relevance(F.col("content"), F.col("tags"), F.col("ks")), 6).alias("relevance"))


@query("txt_render", "SELECT item_id, 'On ' || category || ', ' || conversation || ' said that ' || replace(question, chr(10), ' ') AS line FROM eval_items")
def _(t):
    return t.raw("eval_items").select("item_id", X.rendered_turn(F.col("category"), F.col("conversation"), F.col("question")).alias("line"))


@query("txt_evidence", "SELECT item_id, 'D' || (item_id // 10)::VARCHAR || ':' || (item_id % 10)::VARCHAR AS keys FROM eval_items")
def _(t):
    text = F.concat(F.lit("see D0"), F.floor(F.col("item_id") / 10).cast("string"), F.lit(":0"), (F.col("item_id") % 10).cast("string"), F.lit("; D"), F.floor(F.col("item_id") / 10).cast("string"), F.lit(":"), (F.col("item_id") % 10).cast("string"))
    return t.raw("eval_items").select("item_id", joined(X.evidence_keys(text)).alias("keys"))


@query("txt_turnkey", "SELECT item_id, conversation || '/' || item_id::VARCHAR AS key FROM eval_items")
def _(t):
    return t.raw("eval_items").select("item_id", X.turn_key(F.col("conversation"), F.col("item_id").cast("string")).alias("key"))


@query("txt_fence", r"SELECT doc_id, md5(regexp_replace(CASE WHEN regexp_extract(text, '(?s)```[A-Za-z]*\s*\n?(.*?)```', 1) <> '' THEN regexp_extract(text, '(?s)```[A-Za-z]*\s*\n?(.*?)```', 1) ELSE text END, '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def _(t):
    return t.raw("documents").where("text is not null").select("doc_id", F.md5(X.without_fence(F.col("text"))).alias("digest"))


@query("txt_redact", r"""WITH u AS (SELECT doc_id, 'https://user:pw' || doc_id::VARCHAR || '@h.example/x?token=' || source || '&q=1' AS url FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(url, '(https?://)[^/@\s]+@', '\1REDACTED@', 'g'), '(?i)([?&](?:key|token|api_key|apikey|access_token|secret|password)=)[^&\s]+', '\1REDACTED', 'g') AS url FROM u""")
def _(t):
    url = F.concat(F.lit("https://user:pw"), F.col("doc_id").cast("string"), F.lit("@h.example/x?token="), "source", F.lit("&q=1"))
    return t.raw("documents").select("doc_id", X.redacted_url(url).alias("url"))


# --- scoring -----------------------------------------------------------------------------------

CLAMP = "CASE WHEN {0} IS NULL OR isnan({0}) OR {0} < 0 THEN 0.0 WHEN {0} > 1 THEN 1.0 ELSE {0} END"


def clamp(x: str) -> str:
    return CLAMP.format(f"({x})")


_TC = "(SELECT trace_id, memory_id, max(keyword) AS k, max(vector) AS v, max(entity) AS e FROM trace_candidates GROUP BY 1, 2)"


def candidates(t):
    return t.raw("trace_candidates").groupBy("trace_id", "memory_id").agg(F.max("keyword").alias("k"), F.max("vector").alias("v"), F.max("entity").alias("e"))


@query("m_clamp", f"SELECT trace_id, memory_id, ({clamp('k')})::DOUBLE AS k, ({clamp('v')})::DOUBLE AS v FROM {_TC}")
def _(t):
    return candidates(t).select("trace_id", "memory_id", S.clamp01(F.col("k")).alias("k"), S.clamp01(F.col("v")).alias("v"))


@query("m_fullmatch", f"SELECT trace_id, memory_id, round(CASE WHEN k IS NULL OR isnan(k) OR k <= 0 THEN 0.0 ELSE 0.1 * k END, 8)::DOUBLE AS full_rank FROM {_TC}")
def _(t):
    return candidates(t).select("trace_id", "memory_id", F.round(S.full_match(F.col("k")), 8).alias("full_rank"))


@query("m_bm25norm", f"SELECT trace_id, memory_id, round(CASE WHEN k IS NULL OR k <= 0 THEN 0.0 WHEN isnan(k) THEN 'nan'::DOUBLE ELSE 1 / (1 + exp(-(2.3 / (0.1 * 0.4 * 3)) * (k - 0.1 * 0.4 * 3))) END, 6)::DOUBLE AS s FROM {_TC}")
def _(t):
    return candidates(t).select("trace_id", "memory_id", F.round(S.rank_normal(F.col("k"), F.lit(3)), 6).alias("s"))


@query("m_minmax", f"""WITH c AS (SELECT * FROM {_TC} WHERE v IS NOT NULL AND NOT isnan(v)), r AS (SELECT trace_id, min(v) AS lo, max(v) AS hi FROM c GROUP BY 1)
SELECT c.trace_id, memory_id, round(CASE WHEN hi <= lo THEN 1.0 ELSE (v - lo) / (hi - lo) END, 6)::DOUBLE AS s FROM c JOIN r ON c.trace_id = r.trace_id""")
def _(t):
    c = candidates(t).where("v is not null and not isnan(v)")
    r = c.groupBy("trace_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return c.join(r, "trace_id").select("trace_id", "memory_id", F.round(S.minmax(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("s"))


@query("m_kwscale", f"SELECT trace_id, memory_id, round(CASE WHEN k > 0 AND v > 0 THEN k ** 0.75 * v ** 0.25 ELSE k END, 6)::DOUBLE AS s FROM {_TC} WHERE NOT isnan(k) AND NOT isnan(v)")
def _(t):
    return candidates(t).where("not isnan(k) and not isnan(v) and k is not null and v is not null").select("trace_id", "memory_id", F.round(S.keyword_scale(F.col("k"), F.col("v")), 6).alias("s"))


@query("m_fuse", f"SELECT trace_id, memory_id, round(0.45 * ({clamp('k')}) + 0.4 * ({clamp('v')}) + 0.15 * ({clamp('e')}), 6)::DOUBLE AS s FROM {_TC}")
def _(t):
    return candidates(t).select("trace_id", "memory_id", F.round(S.fused(F.col("k"), F.col("v"), F.col("e")), 6).alias("s"))


@query("m_rrf", f"""WITH r AS (SELECT trace_id, memory_id, e, CASE WHEN k IS NOT NULL THEN rank() OVER (PARTITION BY trace_id ORDER BY k DESC NULLS LAST) END AS rk,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY trace_id ORDER BY v DESC NULLS LAST) END AS rv FROM {_TC})
SELECT trace_id, memory_id, round((coalesce(0.45 / (60 + rk), 0) + coalesce(0.4 / (60 + rv), 0) + 0.15 / 61 * ({clamp('e')})) / (1.0 / 61), 6)::DOUBLE AS s FROM r""")
def _(t):
    from pyspark.sql.window import Window

    rank = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("trace_id").orderBy(F.col(c).desc_nulls_last())))
    r = candidates(t).withColumns({"rk": rank("k"), "rv": rank("v")})
    return r.select("trace_id", "memory_id", F.round(S.fused_rrf(F.col("rk"), F.col("rv"), F.col("e")), 6).alias("s"))


HOURS = f"greatest((epoch_us({SQL_NOW}) - epoch_us(created_at)) / 3.6e9, 0.0)"
FREQ = "CASE WHEN access_count IS NULL OR access_count <= 0 THEN 0.0 ELSE ln(1 + access_count) / ln(11 + access_count) END"
TYPE = "CASE type WHEN 'semantic' THEN 1.0 WHEN 'procedural' THEN 0.95 WHEN 'episodic' THEN 0.9 ELSE 0.0 END"
RECENCY = f"exp(-0.693 * ({HOURS}) / (90 * 24))"


@query("dt_age_hours", f"WITH {MEM} SELECT id, round(({HOURS}) * 3600000)::BIGINT AS age_ms FROM mem")
def _(t):
    return t.memories.select("id", F.round(S.age_hours(t.now, F.col("created_at")) * 3600000).cast("bigint").alias("age_ms"))


@query("m_recency", f"WITH {MEM} SELECT id, round({RECENCY}, 9)::DOUBLE AS s FROM mem")
def _(t):
    return t.memories.select("id", F.round(S.recency(t.now, F.col("created_at")), 9).alias("s"))


@query("m_frequency", f"WITH {MEM} SELECT id, round({FREQ}, 9)::DOUBLE AS s FROM mem")
def _(t):
    return t.memories.select("id", F.round(S.frequency(F.col("access_count")), 9).alias("s"))


@query("m_type", f"WITH {MEM} SELECT id, ({TYPE})::DOUBLE AS s FROM mem")
def _(t):
    return t.memories.select("id", S.type_priority(F.col("type")).cast("double").alias("s"))


def final_sql(relevance: str, superseded: str) -> str:
    return f"((0.75 * ({clamp(relevance)}) + 0.10 * ({RECENCY}) + 0.10 * ({FREQ}) + 0.05 * ({TYPE})) * CASE WHEN {superseded} THEN 0.6 ELSE 1.0 END)"


@query("m_score", f"WITH {MEM} SELECT id, round({final_sql('decay_score', 'access_count > 20')}, 9)::DOUBLE AS s FROM mem")
def _(t):
    s = S.final_score(F.col("decay_score"), t.now, F.col("created_at"), F.col("access_count"), F.col("type"), F.col("access_count") > 20)
    return t.memories.select("id", F.round(s, 9).alias("s"))


DECAY = f"least(1.0, exp(-0.693 * ({HOURS}) / (30 * 24)) * (1 + least(1.0, ln(1 + greatest(access_count, 0)) / 5)))"


@query("m_decay", f"WITH {MEM} SELECT id, round({DECAY}, 9)::DOUBLE AS s FROM mem")
def _(t):
    return t.memories.select("id", F.round(S.decayed(t.now, F.col("created_at"), F.col("access_count")), 9).alias("s"))


@query("m_cosine", f"WITH {MEM}, {EMB}, {ASKED} SELECT asked.query_id, emb.memory_id, round({COSINE.format(a='asked.embedding', b='emb.embedding')}, 6) AS s FROM emb JOIN asked ON emb.project_id = asked.project_id")
def _(t):
    q = t.asked.select("query_id", "project_id", F.col("embedding").alias("q"))
    return t.embeddings.join(q, "project_id").select("query_id", "memory_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("s"))


@query("m_l2norm", f"WITH {EMB} SELECT memory_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)::DOUBLE AS norm, 1.0::DOUBLE AS unit FROM emb")
def _(t):
    u = V.l2_normalized(F.col("embedding"))
    return t.embeddings.select("memory_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.norm(u), 6).alias("unit"))


@query("m_tfweight", f"WITH {MEM}, w AS (SELECT id, unnest({sql_tokens('content')}) AS token FROM mem WHERE content IS NOT NULL) SELECT id, token, round(1 + ln(count(*)), 6)::DOUBLE AS weight FROM w GROUP BY 1, 2")
def _(t):
    w = t.memories.where("content is not null").select("id", F.explode(X.content_tokens(F.col("content"))).alias("token"))
    return w.groupBy("id", "token").agg(F.round(1 + F.log(F.count(F.lit(1))), 6).alias("weight"))


@query("m_combine", f"SELECT trace_id, memory_id, round(greatest(v, e) + 0.25 * least(v, e) * (1 - greatest(v, e)), 6)::DOUBLE AS s FROM {_TC} WHERE NOT isnan(v) AND NOT isnan(e)")
def _(t):
    return candidates(t).where("v is not null and e is not null and not isnan(v) and not isnan(e)").select("trace_id", "memory_id", F.round(S.combined_legacy(F.col("v"), F.col("e")), 6).alias("s"))


@query("m_tier", f"""WITH c AS (SELECT trace_id, memory_id, {clamp('v')} AS v, coalesce(e, 0) AS e FROM {_TC} WHERE e IS NULL OR NOT isnan(e))
SELECT trace_id, memory_id, round(CASE WHEN e > 0 THEN 0.5 + 0.5 * (greatest(e, v) + 0.25 * least(e, v) * (1 - greatest(e, v))) ELSE 0.499 * v END, 6)::DOUBLE AS s FROM c""")
def _(t):
    c = candidates(t).where("e is null or not isnan(e)").withColumn("e", F.coalesce("e", F.lit(0.0)))
    return c.select("trace_id", "memory_id", F.round(S.tiered_legacy(F.col("e"), F.col("v")), 6).alias("s"))


@query("m_entboost", f"SELECT trace_id, memory_id, round({clamp('v + 0.05 * e')}, 6)::DOUBLE AS s FROM {_TC} WHERE NOT isnan(v) AND NOT isnan(e)")
def _(t):
    return candidates(t).where("v is not null and e is not null and not isnan(v) and not isnan(e)").select("trace_id", "memory_id", F.round(S.entity_boosted_legacy(F.col("v"), F.col("e")), 6).alias("s"))


@query("dt_locomo", """SELECT item_id, epoch_us(TIMESTAMPTZ '2023-05-08 13:00:00+00' + to_minutes((item_id % 60)::INT)) AS micros FROM eval_items""")
def _(t):
    text = F.concat(F.lit("1:"), F.lpad((F.col("item_id") % 60).cast("string"), 2, "0"), F.lit(" pm on 8 May, 2023"))
    return t.raw("eval_items").select("item_id", F.unix_micros(conversations.session_time(text)).alias("micros"))


@query("js_tags", f"WITH {MEM} SELECT id, CASE WHEN len(tags) = 0 THEN '[]' ELSE '[\"' || array_to_string(tags, '\",\"') || '\"]' END AS tags FROM mem")
def _(t):
    return t.memories.select("id", X.json_tags(X.parsed_tags(X.json_tags(F.col("tags")))).alias("tags"))


UUID5 = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32]
  FROM (SELECT sha1(unhex(replace('{namespace}', '-', '')) || encode({name})) AS h))"""


@query("id_uuid5", f"SELECT item_id, {UUID5.format(namespace=conversations.NAMESPACE, name="conversation || '/' || item_id::VARCHAR")} AS uuid FROM eval_items WHERE conversation IS NOT NULL")
def _(t):
    return t.raw("eval_items").select("item_id", conversations.uuid5(conversations.NAMESPACE, X.turn_key(F.col("conversation"), F.col("item_id").cast("string"))).alias("uuid"))


@query("arr_vec_text", f"WITH {EMB} SELECT memory_id, len(embedding)::BIGINT AS n FROM emb")
def _(t):
    return t.embeddings.select("memory_id", F.size(F.split(V.as_text(F.col("embedding")), ",")).cast("bigint").alias("n"))


@query("val_uuid", f"WITH {MEM} SELECT id, regexp_matches(id, '^[0-9a-fA-F-]{{36}}$') AS ok FROM mem")
def _(t):
    return t.memories.select("id", X.is_plain_uuid(F.col("id")).alias("ok"))


@query("val_hash", f"WITH {MEM} SELECT id, coalesce(regexp_matches(content_hash, '^[0-9a-f]{{32}}$'), false) AS ok FROM mem")
def _(t):
    return t.memories.select("id", X.is_content_hash(F.col("content_hash")).alias("ok"))


@query("val_rel", "SELECT id, coalesce(relationship IN ('belongs_to', 'contains', 'relates_to', 'supersedes', 'caused_by', 'mentions'), false) AS ok FROM edges")
def _(t):
    from loci.operators.graph import valid_relationship

    return t.raw("edges").select("id", valid_relationship(F.col("relationship")).alias("ok"))


@query("flt_zero_vec", f"SELECT memory_id, count(*) AS n FROM memory_embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) = 0 GROUP BY 1")
def _(t):
    return t.raw("memory_embeddings").where("embedding is not null").where(V.is_zero(F.col("embedding"))).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))

