"""Retrieval metrics over ranked results and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions import scoring as S

DEPTH = 10


def first_ranks(ranked: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(question_id, evidence_key, rank)``: rank of the first result that covers each piece of evidence, null if none does.

    ``ranked`` is ``(question_id, rank, id)``, ``sources`` ``(id, evidence_key)``, ``evidence``
    ``(question_id, evidence_key)``. Repeated rows count once.
    """
    wanted = evidence.select("question_id", "evidence_key").distinct()
    covered = ranked.join(sources.distinct(), "id").groupBy("question_id", "evidence_key").agg(F.min("rank").alias("rank"))
    return wanted.join(covered, ["question_id", "evidence_key"], "left")


def question_scores(ranks: DataFrame, k: int = DEPTH, known: DataFrame | None = None) -> DataFrame:
    """``(question_id, evidence, hit, recall, full, mrr, ndcg)`` per question at depth ``k``.

    Evidence that is in no stored document (not in ``known(evidence_key)``) does not count; a
    question without any other is not scorable and has no row.
    """
    if known is not None:
        ranks = ranks.join(known.distinct(), "evidence_key", "left_semi")
    found = F.col("rank") <= k
    gain = F.when(F.col("rank") <= DEPTH, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = ranks.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("evidence"), F.sum(F.when(found, 1).otherwise(0)).alias("n"), F.min("rank").alias("first"), F.sum(gain).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("evidence"), F.lit(DEPTH)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    return per.select(
        "question_id", "evidence", (F.col("n") > 0).cast("double").alias("hit"), (F.col("n") / F.col("evidence")).alias("recall"),
        (F.col("n") == F.col("evidence")).cast("double").alias("full"), S.reciprocal_rank(F.col("first"), DEPTH).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def aggregate(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """``(category, n, unscorable, hit, recall, full, mrr, ndcg)`` by category, for 'all', and for 'answerable' (not adversarial)."""
    groups = F.explode(F.when(F.col("category") == "adversarial", F.array("category", F.lit("all"))).otherwise(F.array("category", F.lit("all"), F.lit("answerable")))).alias("group")
    rows = questions.select("question_id", "category").join(scores, "question_id", "left").select(groups, "evidence", "hit", "recall", "full", "mrr", "ndcg")
    ok = F.col("evidence").isNotNull()
    return rows.groupBy(F.col("group").alias("category")).agg(
        F.sum(ok.cast("long")).alias("n"), F.sum((~ok).cast("long")).alias("unscorable"), *[F.avg(c).alias(c) for c in ("hit", "recall", "full", "mrr", "ndcg")]
    )


def digest(ranked: DataFrame) -> DataFrame:
    """``(digest)``: SHA-256 over the ranked lists, one line per question in order of its id.

    Lines are hashed per question first, so the last step gathers one hash per question only.
    """
    lines = ranked.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda r: r["id"]), ",").alias("ids"))
    hashed = lines.select("question_id", F.sha2(F.concat(F.col("question_id").cast("string"), F.lit(":"), "ids"), 256).alias("h"))
    return hashed.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("question_id", "h"))), lambda r: r["h"]), "\n"), 256).alias("digest"))


def nearest_rank(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Nearest-rank percentile per group, over weighted values (see ``skew.key_percentiles``)."""
    from loci.operators.skew import key_percentiles

    return key_percentiles(df, group, value, [share])


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """``(le, n)``: cumulative counts of values up to each bound and in all, as metric histograms keep them."""
    edges = [*bounds, float("inf")]
    up_to = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.when(F.col(value) <= b, 1).otherwise(0).alias("in")) for b in edges]))
    return df.where(F.col(value).isNotNull()).select(up_to.alias("b")).groupBy("b.le").agg(F.sum("b.in").alias("n"))


def trace(results: DataFrame, pools: dict[str, DataFrame], evidence_ids: DataFrame) -> DataFrame:
    """``(question_id, id, <pool>_rank..., final_rank)``: where each evidence document stands in every pool and in the end.

    Pools are ``(question_id, id, rank)``.
    """
    out = evidence_ids.select("question_id", "id").distinct()
    for name, pool in pools.items():
        out = out.join(pool.select("question_id", "id", F.col("rank").alias(f"{name}_rank")), ["question_id", "id"], "left")
    return out.join(results.select("question_id", "id", F.col("rank").alias("final_rank")), ["question_id", "id"], "left")


def aligned(extracted: DataFrame, turns: DataFrame) -> DataFrame:
    """``(id, turn_key, share)``: for each extracted memory the turn of its conversation with the greatest share of its words.

    ``extracted`` is ``(id, conversation, words)``, ``turns`` ``(turn_key, conversation, words)``.
    """
    a = extracted.select("id", "conversation", F.size(F.array_distinct("words")).alias("n"), F.explode(F.array_distinct("words")).alias("word"))
    b = turns.select("turn_key", "conversation", F.explode(F.array_distinct("words")).alias("word"))
    common = a.join(b, ["conversation", "word"]).groupBy("id", "turn_key").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    # Greatest share, then smallest key.
    best = common.groupBy("id").agg(F.max("share").alias("share"))
    return common.join(best, ["id", "share"]).groupBy("id", "share").agg(F.min("turn_key").alias("turn_key")).select("id", "turn_key", "share")


def report_lines(metrics: DataFrame) -> Column:
    """One text line per row of ``aggregate``."""
    number = lambda c: F.format_number(c, 3)
    return F.concat_ws("  ", F.rpad("category", 12, " "), F.lpad(F.col("n").cast("string"), 5, " "), *[number(c) for c in ("hit", "recall", "full", "mrr", "ndcg")])
