"""Hashed bag-of-words vectors and the English analyser."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import lists as L
from loci.functions.english import lexemes
from loci.operators import embed
from loci.plans.base import MEM, query, quoted, sql_split

_T = f"list_filter({sql_split('content', L.TRIM_EMBED)}, lambda w: strlen(w) >= 2 AND w NOT IN ({quoted(L.EMBED_STOP)}))"
_FNV = """list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ('0x' || substring(hex(encode({0})), 2 * i - 1, 2))::UBIGINT)),
  lambda h, b: (xor(h, b) * 16777619) & 4294967295::UBIGINT)"""
SPARSE = f"""
tok AS (SELECT id, {_T} AS w FROM mem WHERE content IS NOT NULL),
cnt AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(w) AS token FROM tok) GROUP BY 1, 2),
ft AS (SELECT token, {_FNV.format('token')} % 384 AS a, {_FNV.format("(token || '_salt')")} % 384 AS b, CASE WHEN {_FNV.format("(token || '_sign')")} % 2 = 0 THEN -1.0 ELSE 1.0 END AS sign FROM (SELECT DISTINCT token FROM cnt)),
prs AS (SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS pair FROM tok),
pcell AS (SELECT pair, {_FNV.format('pair')} % 384 AS cell FROM (SELECT DISTINCT pair FROM prs)),
adds AS (
  SELECT id, unnest([a, b]) AS cell, (1 + ln(tf)) * sign AS value FROM cnt JOIN ft ON ft.token = cnt.token
  UNION ALL SELECT id, cell, 0.5 FROM prs JOIN pcell ON pcell.pair = prs.pair),
summed AS (SELECT id, cell, sum(value) AS value FROM adds GROUP BY 1, 2 HAVING abs(sum(value)) > 1e-12),
unit AS (SELECT id, cell, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM summed)"""


def cells(t):
    return embed.sparse(t.memories.where("content is not null").select("id", F.col("content").alias("text")))


@query("op_embed_bow", f"WITH {MEM}, {SPARSE} SELECT id, cell::BIGINT AS cell, round(value, 6)::DOUBLE AS value FROM unit")
def _(t):
    return cells(t).select("id", "cell", F.round("value", 6).alias("value"))


@query("op_load_corpus", f"WITH {MEM}, {SPARSE} SELECT id, count(*) AS cells FROM unit GROUP BY 1")
def _(t):
    return embed.dense(cells(t)).select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("cells"))


class Hashing:
    """A provider in pure Python, to run the external interface without a network."""

    dim = 8

    def embed(self, texts):
        return [[float(len(t) % (k + 2)) for k in range(self.dim)] for t in texts]


for _name in ("op_embed_batch", "conn_embed_http"):

    @query(_name, f"WITH {MEM} SELECT id, (length(coalesce(content, '')) % 2)::DOUBLE AS first, (length(coalesce(content, '')) % 9)::DOUBLE AS last FROM mem")
    def _(t):
        got = embed.embed_with(t.memories.select("id", F.col("content").alias("text")), Hashing)
        return got.select("id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[7].cast("double").alias("last"))


@query("fts_lex")
def _(t):
    return t.memories.where("content is not null").select("id", F.array_join(lexemes(F.col("content")), " ").alias("lexemes"))
