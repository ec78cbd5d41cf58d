"""Maintenance: merge of identical contents, decay, prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.config import EngineConfig
from loci.functions import scoring as S
from loci.operators import graph


def merges(memories: DataFrame) -> DataFrame:
    """supersedes edges from the newest of identical semantic contents of a project to the others: ``(from_id, to_id, relationship, weight)``.

    The newest is found by a combinable aggregate and joined back, so a content that fills a third
    of the table is no single task's group.
    """
    rows = memories.where("type = 'semantic' and content is not null and project_id is not null")
    key = F.sha2("content", 256).alias("key")
    best = rows.groupBy("project_id", key).agg(F.max_by("id", F.struct("created_at", F.col("id"))).alias("from_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = rows.select("id", "project_id", key).join(best, ["project_id", "key"]).where("id <> from_id")
    return pairs.select("from_id", F.col("id").alias("to_id"), F.lit("supersedes").alias("relationship"), F.lit(1.0).alias("weight"))


def merge_phase(memories: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """The edge table after merging; a second run adds nothing."""
    made = merges(memories).withColumns({"id": F.sha1(F.concat_ws("|", "from_id", "to_id", "relationship")), "created_at": now})
    return graph.add_edges(made.select(*edges.columns), edges, memories)


def decay_phase(memories: DataFrame, now: Column, half_life_days: float = S.DECAY_DAYS) -> DataFrame:
    return memories.withColumn("decay_score", S.decayed(now, F.col("created_at"), F.col("access_count"), half_life_days))


def stale(memories: DataFrame, now: Column, below: float = S.STALE, age_days: float = S.STALE_DAYS) -> DataFrame:
    """Memories to prune: decay under ``below``, never read, older than ``age_days``; all strict."""
    old = S.age_hours(now, F.col("created_at")) / 24 > age_days
    return memories.where((F.col("decay_score") < below) & (F.col("access_count") == 0) & old)


def consolidate(tables: dict[str, DataFrame], now: Column, config: EngineConfig | None = None) -> dict[str, DataFrame]:
    """All tables after merge, decay and prune, in this order; prune sees the new decay."""
    c = (config or EngineConfig()).validate()
    out = dict(tables)
    out["edges"] = merge_phase(tables["memories"], tables["edges"], now)
    out["memories"] = decay_phase(tables["memories"], now, c.half_life_days)
    gone = stale(out["memories"], now, c.stale_below, c.prune_age_days).select("id")
    return graph.delete(gone, out)


def consolidation_report(tables: dict[str, DataFrame], now: Column, config: EngineConfig | None = None) -> DataFrame:
    """``(phase, n)``: new edges by merge, memories whose decay moved, memories pruned."""
    c = (config or EngineConfig()).validate()
    before, after = tables["edges"], merge_phase(tables["memories"], tables["edges"], now)
    key = ["from_id", "to_id", "relationship"]
    merged = after.join(before, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("merged").alias("phase"), "n")
    fresh = decay_phase(tables["memories"], now, c.half_life_days)
    moved = fresh.select("id", F.col("decay_score").alias("new")).join(tables["memories"].select("id", "decay_score"), "id").where(F.abs(F.col("new") - F.col("decay_score")) > 1e-9)
    moved = moved.agg(F.count(F.lit(1)).alias("n")).select(F.lit("decayed").alias("phase"), "n")
    pruned = stale(fresh, now, c.stale_below, c.prune_age_days).agg(F.count(F.lit(1)).alias("n")).select(F.lit("pruned").alias("phase"), "n")
    return merged.unionByName(moved).unionByName(pruned)


def degraded(failed: int, attempted: int, ratio: float = 0.1) -> bool:
    """Whether too many of a run's writes failed."""
    return attempted > 0 and failed / attempted > ratio
