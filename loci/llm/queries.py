"""The queries of this package: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loci.llm import leakage, leximin, neardup, packing, parsimony, pii, truncation, vectors
from loci.runtime import table

SCORES = ("keyword", "vector", "entity")


def _personal(spark: SparkSession, d: str, source: str, ident: str, text: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, d, source, ident, text), table(spark, d, "name_parts"), ident, text)
    return found.select(F.lit(source).alias("source_table"), F.col("id").alias("record_id"), "kind", "item_no")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = _personal(spark, d, "memories", "id", "content").unionByName(_personal(spark, d, "world_customers", "id", "email"))
    return both.distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    def one(source: str, ident: str, text: str) -> DataFrame:
        clean = pii.redact(table(spark, d, source, ident, text), table(spark, d, "name_parts"), ident, text)
        return clean.select(F.lit(source).alias("source_table"), F.col(ident).alias("record_id"), F.col(text).alias("text"))

    return one("memories", "id", "content").unionByName(one("world_customers", "id", "email"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vectors.similar_pairs(table(spark, d, "memory_embeddings", "memory_id", "embedding"))
    return pairs.select(F.col("a").alias("memory_id_a"), F.col("b").alias("memory_id_b"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every usable vector; cosines that agree to nine digits are ordered by id."""
    near = vectors.nearest_of_all(table(spark, d, "memory_embeddings", "memory_id", "embedding"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other"))
    return near.select(F.col("id").alias("memory_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), rank.cast("bigint").alias("rank"))


def p2_nearest_of_queries(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest five of every vector whose id, read as a number, is divisible by 100, against all rows."""
    rows = table(spark, d, "memory_embeddings", "memory_id", "embedding")
    asked = rows.where(F.conv(F.substring("memory_id", 1, 8), 16, 10).cast("bigint") % 100 == 0)
    near = vectors.nearest_exact(rows, asked)
    return near.select(F.col("id").alias("memory_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs at 0.7 among memories of at least 20 different words."""
    return neardup.near_duplicate_pairs(table(spark, d, "memories", "id", "content"), threshold=0.7, least=20).select("id_a", "id_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every memory, however short; one without words is a group of its own."""
    rows = table(spark, d, "memories", "id", "content")
    groups = neardup.near_duplicate_groups(rows, threshold=0.7).groupBy("id").agg(F.min("group_id").alias("group_id"))
    ids = rows.where("id is not null").select("id").distinct()
    return ids.join(groups, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.leximin_first(table(spark, d, "trace_candidates"), "trace_id", "memory_id", SCORES)


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranks = leximin.leximin_ranks(table(spark, d, "trace_candidates"), "trace_id", "memory_id", SCORES)
    return ranks.select("trace_id", "memory_id", F.round(F.col("weakest_first")[0], 6).alias("weakest"), "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    terms = parsimony.distinctive_terms(table(spark, d, "memories", "id", "content"), min_tf=3, min_df=2, max_df=10)
    return terms.select(F.col("id").alias("memory_id"), "term")


def p6_weights(spark: SparkSession, d: str) -> DataFrame:
    return parsimony.distinctive_terms(table(spark, d, "memories", "id", "content")).withColumnRenamed("id", "memory_id")


def _packed(spark: SparkSession, d: str, largest_only: bool) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    rows = table(spark, d, "pack_budgets").select("budget_id", "capacity_tokens").orderBy(F.desc("capacity_tokens"), "budget_id").collect()
    budgets = [(r[0], r[1]) for r in rows]
    return packing.pack(packing.token_counts(docs), budgets[:1] if largest_only else budgets, count_of=table(spark, d, "documents", "doc_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, True).where(F.col("parts") > 1).select(F.col("id").alias("doc_id")).distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, False).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packed(spark, d, False))


def _tests(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "passage", "question")
    one = lambda c: items.select(F.col("item_id").alias("item"), F.lit(c).alias("field"), F.col(c).alias("text"))
    return one("passage").unionByName(one("question"))


def p8_phrases(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.phrase_matches(table(spark, d, "documents", "doc_id", "text"), _tests(spark, d))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_phrases(spark, d).select("doc_id", "item_id").distinct()


def p8_proximity(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.proximity_matches(table(spark, d, "documents", "doc_id", "text"), _tests(spark, d))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.assessed(table(spark, d, "documents", "doc_id", "text", "source")).where("truncated").select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_shares(table(spark, d, "documents", "doc_id", "text", "source")).withColumn("share", F.round("share", 6))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.length_limits(table(spark, d, "documents", "doc_id", "text", "source"))
    return found.select("source", "unit", F.col("limit").cast("bigint").alias("max_length"), F.col("texts_at_limit").cast("bigint").alias("texts_at_limit"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p2_found, p2_neighbours, p2_nearest_of_queries, p3_found, p3_groups, p4_found, p4_ranking, p6_found, p6_weights,
        p7_found, p7_containers, p7_fill, p8_found, p8_phrases, p8_proximity, p9_found, p9_shares, p9_limits,
    )
}
