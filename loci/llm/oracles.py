"""Plain SQL for the queries of this package that SQL can express on whole tables."""

from __future__ import annotations

#: Words of a memory: lower case, split at white space, edges trimmed, empty ones dropped.
_WORDS = r"""list_filter(list_transform(regexp_split_to_array(lower(content), '\s+'), lambda x: trim(x, '.,;:!?"''()[]{}<>')), lambda x: x <> '')"""
_USABLE = """
usable AS (
  SELECT memory_id, any_value(embedding) AS v FROM memory_embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY memory_id)"""
_LEXIMIN = """
clean AS (
  SELECT trace_id, memory_id,
    max(CASE WHEN keyword >= 0 AND NOT isnan(keyword) THEN keyword END) AS s1,
    max(CASE WHEN vector >= 0 AND NOT isnan(vector) THEN vector END) AS s2,
    max(CASE WHEN entity >= 0 AND NOT isnan(entity) THEN entity END) AS s3
  FROM trace_candidates WHERE trace_id IS NOT NULL AND memory_id IS NOT NULL GROUP BY 1, 2),
shares AS (
  SELECT trace_id, memory_id,
    percent_rank() OVER (PARTITION BY trace_id ORDER BY s1 NULLS FIRST) AS p1,
    percent_rank() OVER (PARTITION BY trace_id ORDER BY s2 NULLS FIRST) AS p2,
    percent_rank() OVER (PARTITION BY trace_id ORDER BY s3 NULLS FIRST) AS p3
  FROM clean),
ordered AS (SELECT trace_id, memory_id, list_sort([p1, p2, p3]) AS w FROM shares),
ranked AS (SELECT trace_id, memory_id, w, rank() OVER (PARTITION BY trace_id ORDER BY w[1] DESC, w[2] DESC, w[3] DESC) AS r FROM ordered)"""

#: The limits of a source, how a text ends, and what is cut.
_ENDS = r"""
texts AS (SELECT DISTINCT source, text FROM documents WHERE length(trim(text)) > 0),
lens AS (
  SELECT source, 'chars' AS unit, length(text) AS n FROM texts
  UNION ALL SELECT source, 'bytes', strlen(text) FROM texts),
tops AS (SELECT *, max(n) OVER (PARTITION BY source, unit) AS top FROM lens),
counts AS (
  SELECT source, unit, top, count(*) FILTER (n > top - 4) AS texts_at_limit, count(*) FILTER (n > top / 2 AND n <= top - 4) AS upper
  FROM tops GROUP BY 1, 2, 3),
limits AS (
  SELECT source, max(top) FILTER (unit = 'chars') AS max_chars, max(top) FILTER (unit = 'bytes') AS max_bytes FROM counts
  WHERE texts_at_limit >= 5 AND texts_at_limit >= 20.0 * upper / greatest(top / 2 - 4, 1) GROUP BY 1),
tails AS (SELECT doc_id, source, text, regexp_replace(right(text, 400), '\s+$', '') AS tail FROM documents),
lines AS (
  SELECT *, trim(split_part(tail, chr(10), -1)) AS last, trim(coalesce(string_split(tail, chr(10))[-2], '')) AS before,
    (length(text) - length(replace(text, '```', ''))) // 3 AS fences FROM tails),
ends AS (
  SELECT doc_id, source, text, CASE
    WHEN text IS NULL OR length(tail) = 0 THEN 'blank'
    WHEN regexp_matches(tail, '(\.\.\.|…|\x{FFFD}|\[\.\.\.\]|\[…\]|[\[(<](truncated|cut|snip|more)[\])>])["''”’)\]]*$') THEN 'marked'
    WHEN regexp_matches(last, '^\s*[-*>]?\s*(\d{1,3}|[a-zA-Z])[.)]$') THEN 'number'
    WHEN regexp_matches(tail, '(^|[^.])[.!?。！？]["''”’»)\]}*_`]*$') OR regexp_matches(tail, '[.!?:"”]\s*[(\[][^()\[\]\n]{1,60}[)\]]$') THEN 'terminal'
    WHEN last = '```' AND fences % 2 = 0 THEN 'closing'
    WHEN regexp_matches(before, '(?i)^(best|best regards|regards|kind regards|thanks|thank you|cheers|sincerely|yours|viele grüße|mit freundlichen grüßen|grüße|saludos|un saludo|gracias),?$')
      AND regexp_matches(last, '^\p{Lu}[\p{L}''-]*( \p{Lu}[\p{L}''.-]*){0,2}$') THEN 'closing'
    WHEN regexp_matches(last, '^(--?\s*\p{L}[\p{L} .''-]{0,40}|(#[\p{L}\d_-]+\s*)+|EOF|END|###|[-*] \[[ xX]\] \p{L}+|[\[(<][^\[\]()<>\n]{1,60}[\])>]|<?https?://\S+>?)$') THEN 'closing'
    ELSE 'open' END AS ending FROM lines),
assessed AS (
  SELECT doc_id, e.source, ending, at_limit, ending IN ('open', 'marked') OR (at_limit AND ending IN ('closing', 'number')) AS truncated
  FROM (SELECT e.*, coalesce(length(text) > max_chars - 4, false) OR coalesce(strlen(text) > max_bytes - 4, false) AS at_limit
    FROM ends e LEFT JOIN limits m ON m.source IS NOT DISTINCT FROM e.source) e)"""

ORACLES = {
    "p9_found": f"""
WITH {_ENDS}
SELECT DISTINCT doc_id FROM assessed WHERE truncated""",
    "p9_shares": f"""
WITH {_ENDS}
SELECT source, count(*) AS texts, count(*) FILTER (truncated)::BIGINT AS truncated, count(*) FILTER (truncated AND at_limit)::BIGINT AS at_limit,
  round(avg(truncated::INT), 6)::DOUBLE AS share
FROM assessed WHERE ending <> 'blank' GROUP BY 1""",
    "p2_found": f"""
WITH {_USABLE},
pairs AS (
  SELECT a.memory_id AS a, b.memory_id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c
  FROM usable a JOIN usable b ON a.memory_id <> b.memory_id),
best AS (SELECT a, b FROM pairs WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS memory_id_a, greatest(a, b) AS memory_id_b FROM best""",
    "p2_nearest_of_queries": f"""
WITH {_USABLE},
pairs AS (
  SELECT a.memory_id AS a, b.memory_id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c
  FROM usable a JOIN usable b ON a.memory_id <> b.memory_id
  WHERE ('0x' || a.memory_id[1:8])::BIGINT % 100 = 0)
SELECT a AS memory_id, b AS neighbour_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rank
FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5""",
    "p2_neighbours": f"""
WITH {_USABLE},
pairs AS (
  SELECT a.memory_id AS a, b.memory_id AS b, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c
  FROM usable a JOIN usable b ON a.memory_id <> b.memory_id)
SELECT a AS memory_id, b AS neighbour_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS rank
FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 5""",
    "p3_groups": f"""
WITH RECURSIVE sets AS (
  SELECT id, list_distinct({_WORDS}) AS w FROM (SELECT id, any_value(content) AS content FROM memories WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)),
words AS (SELECT id, len(w) AS n, unnest(w) AS word FROM sets WHERE len(w) > 0),
shared AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM words a JOIN words b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared WHERE k >= 0.7 * (na + nb - k) UNION ALL SELECT b, a FROM shared WHERE k >= 0.7 * (na + nb - k)),
reach AS (SELECT DISTINCT id, id AS to_ FROM memories WHERE id IS NOT NULL UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_)
SELECT id, min(to_) AS group_id FROM reach GROUP BY id""",
    "p7_found": r"""
SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 4096""",
    "p3_found": f"""
WITH sets AS (
  SELECT id, list_distinct({_WORDS}) AS w FROM (SELECT id, any_value(content) AS content FROM memories WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)),
long AS (SELECT id, len(w) AS n, unnest(w) AS word FROM sets WHERE len(w) >= 20),
shared AS (
  SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM long a JOIN long b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM shared WHERE k >= 0.7 * (na + nb - k)""",
    "p4_found": f"""
WITH {_LEXIMIN}
SELECT trace_id, min(memory_id) AS memory_id FROM ranked WHERE r = 1 GROUP BY trace_id""",
    "p4_ranking": f"""
WITH {_LEXIMIN}
SELECT trace_id, memory_id, round(w[1], 6) AS weakest, r AS rank FROM ranked""",
    "p6_found": f"""
WITH words AS (
  SELECT id, unnest({_WORDS}) AS term FROM (SELECT id, any_value(content) AS content FROM memories WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)),
tf AS (SELECT id, term, count(*) AS n FROM words GROUP BY 1, 2),
df AS (SELECT term, count(*) AS m FROM tf GROUP BY 1)
SELECT id AS memory_id, term FROM tf JOIN df USING (term) WHERE n >= 3 AND m BETWEEN 2 AND 10""",
    "p8_phrases": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
tests AS (
  SELECT item_id, 'passage' AS field, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items
  UNION ALL SELECT item_id, 'question', regexp_extract_all(lower(question), '[\p{L}\p{N}]+') FROM eval_items),
a AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs WHERE len(w) >= 12)),
b AS (SELECT DISTINCT item_id, field, j, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT item_id, field, w, unnest(range(1, len(w) - 10)) AS j FROM tests WHERE len(w) >= 12)),
hits AS (SELECT doc_id, item_id, field, i - j AS base, j, j - row_number() OVER (PARTITION BY doc_id, item_id, field, i - j ORDER BY j) AS run FROM a JOIN b USING (g)),
runs AS (SELECT doc_id, item_id, field, count(*) + 11 AS words FROM hits GROUP BY doc_id, item_id, field, base, run)
SELECT doc_id, item_id, field, max(words) AS words FROM runs GROUP BY 1, 2, 3""",
    "p8_found": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
tests AS (
  SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items
  UNION ALL SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') FROM eval_items),
a AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs WHERE len(w) >= 12)),
b AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM tests WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)""",
    "p9_limits": r"""
WITH texts AS (SELECT DISTINCT source, text FROM documents WHERE length(trim(text)) > 0),
lens AS (
  SELECT source, 'chars' AS unit, length(text) AS n FROM texts
  UNION ALL SELECT source, 'bytes', strlen(text) FROM texts),
tops AS (SELECT *, max(n) OVER (PARTITION BY source, unit) AS top FROM lens),
counts AS (
  SELECT source, unit, top, count(*) FILTER (n > top - 4) AS texts_at_limit, count(*) FILTER (n > top / 2 AND n <= top - 4) AS upper
  FROM tops GROUP BY 1, 2, 3)
SELECT source, unit, top AS max_length, texts_at_limit FROM counts
WHERE texts_at_limit >= 5 AND texts_at_limit >= 20.0 * upper / greatest(top / 2 - 4, 1)""",
}
