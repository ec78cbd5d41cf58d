"""Project profiles and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Defaults and greatest values.
PROFILE_ROWS, PROFILE_ROWS_MOST, PROFILE_DAYS, PROFILE_DAYS_MOST = 200, 1000, 7, 365


def profiles(memories: DataFrame, now: Column, rows: int = 0, days: int = 0) -> DataFrame:
    """``(project_id, section, id, content, type, confidence, tags)`` from the newest rows of every project.

    Semantic and procedural ones are 'static'; episodic ones created after the cutoff 'dynamic';
    older episodic ones are in neither.
    """
    rows = PROFILE_ROWS if rows <= 0 else min(rows, PROFILE_ROWS_MOST)
    days = PROFILE_DAYS if days <= 0 else min(days, PROFILE_DAYS_MOST)
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id"))
    recent = memories.where("project_id is not null").withColumn("n", rank).where(F.col("n") <= rows)
    cutoff = now - F.make_dt_interval(F.lit(days))
    section = F.when(F.col("type").isin("semantic", "procedural"), "static").when((F.col("type") == "episodic") & (F.col("created_at") > cutoff), "dynamic")
    facts = recent.select("project_id", section.alias("section"), "id", "content", "type", F.col("decay_score").alias("confidence"), "tags")
    return facts.where("section is not null")


def profile_totals(memories: DataFrame, rows: int = 0) -> DataFrame:
    """``(project_id, total)``: rows a profile looks at."""
    rows = PROFILE_ROWS if rows <= 0 else min(rows, PROFILE_ROWS_MOST)
    per = memories.where("project_id is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("project_id", F.least(F.col("n"), F.lit(rows).cast("bigint")).alias("total"))


def start_sessions(new: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with new ones appended; agent and project are required."""
    if not new.where("coalesce(agent_id, '') = '' or coalesce(project_id, '') = ''").isEmpty():
        raise ValueError("agent_id and project_id are required")
    return sessions.unionByName(new.withColumn("ended_at", F.lit(None).cast("timestamp")).select(*sessions.columns))


def end_sessions(ends: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with ``ends(id, ended_at)`` set; an unknown id is an error, and so is one that has ended (its first end stays)."""
    if not ends.join(sessions, "id", "left_anti").isEmpty():
        raise LookupError("unknown session")
    if not ends.join(sessions.where("ended_at is not null"), "id", "left_semi").isEmpty():
        raise ValueError("session has ended before")
    marks = ends.groupBy("id").agg(F.min("ended_at").alias("__end"))
    return sessions.join(marks, "id", "left").withColumn("ended_at", F.coalesce("ended_at", "__end")).select(*sessions.columns)


def sessions_by_gap(events: DataFrame, user: str, at: str, minutes: int = 30) -> DataFrame:
    """``(user, started_at, ended_at, events)``: runs of events whose gaps are under ``minutes``.

    By session windows, which are merged on the map side first. Null users and times take no part.
    """
    rows = events.where(F.col(user).isNotNull() & F.col(at).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    runs = rows.groupBy(user, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("events"))
    return runs.select(user, "started_at", "ended_at", "events")
