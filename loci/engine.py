"""The public verbs over a store of tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.config import EngineConfig, top_k
from loci.functions import lists as L
from loci.functions import text as X
from loci.operators import embed, evaluate, extract, graph, ingest, maintain, memories, profile, retrieve
from loci.runtime import stored
from loci.sources.store import KEYS, PLACE, Conflict, Snapshot, Store

#: Times a write starts again because another writer committed first.
WRITE_ATTEMPTS = 5


class Engine:
    """store, query, connect, delete, graph, extract, profile, sessions, stats and consolidate.

    ``now`` is the clock of all scoring; set it for results that can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, now: dt.datetime | None = None) -> None:
        self.spark, self.config = spark, (config or EngineConfig()).validate()
        self.tables = Store(spark, path).init()
        self._now = now

    @property
    def now(self):
        stamp = self._now or dt.datetime.now(dt.timezone.utc)
        return F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")

    def _vectors(self, rows: DataFrame) -> DataFrame:
        """``(id, embedding)`` of ``rows(id, text)`` by hashed words; texts without words have none."""
        return embed.dense(embed.sparse(rows, self.config.dim), self.config.dim)

    def store(self, new: DataFrame, fold: bool = False) -> DataFrame:
        """Store ``new(content, type, project_id[, tags, session_id])``; returns the rows as stored. Content, project and a known type are required."""
        for c, kind in (("tags", "array<string>"), ("session_id", "string")):
            if c not in new.columns:
                new = new.withColumn(c, F.lit(None).cast(kind))
        bad = new.where("coalesce(trim(content), '') = '' or coalesce(project_id, '') = ''" f" or coalesce(type, '') not in ({', '.join(repr(t) for t in L.MEMORY_TYPES)})")
        if not bad.isEmpty():
            raise ValueError("content, project_id and a known type are required")
        sessions = self.tables.read("sessions")
        if not new.where("session_id is not null").join(sessions.withColumnRenamed("id", "session_id"), "session_id", "left_anti").isEmpty():
            raise LookupError("unknown session")
        return self._ingest(self._fixed(new), fold)

    def _fixed(self, new: DataFrame) -> DataFrame:
        """Rows with ids that stay the same however often the plan runs: written once, then read."""
        part = lambda a, n: F.substring("__made", a, n)
        rows = new.withColumn("__made", F.sha1(F.concat_ws("|", F.uuid(), "content"))).select(
            F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)).alias("id"), "content", "type", "project_id",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), self.now.alias("created_at"), F.lit(0).cast("bigint").alias("access_count"),
            F.lit(1.0).alias("decay_score"), X.content_hash(F.col("content")).alias("content_hash"), "session_id",
        )
        return stored(rows, "new")

    def _committed(self, work):
        """Run ``work(snapshot)``, which commits on the snapshot, until no other writer was faster."""
        for left in reversed(range(WRITE_ATTEMPTS)):
            try:
                return work(self.tables.snapshot())
            except Conflict:
                if not left:
                    raise

    def _ingest(self, rows: DataFrame, fold: bool) -> DataFrame:
        vectors = self._vectors(rows.select("id", F.col("content").alias("text")))
        with_vector = stored(rows.join(vectors, "id", "left"), "with_vector")
        places = self.tables.buckets(rows)

        def work(at: Snapshot) -> None:
            # Only the buckets of the batch's projects are read, and only changed rows are written.
            t = self.tables.tables(at, places)
            out = ingest.changes(with_vector.drop("session_id"), t["memories"], t["embeddings"], self.config.dim, self.now, fold)
            kept = stored(rows.join(out["folded"].select(F.col("new_id").alias("id")), "id", "left_anti"), "rows")
            named = stored(extract.memory_entities(kept).join(kept.select("id", "project_id"), "id"), "named")
            entities, mentions = graph.new_links(named, t["entities"], t["mentions"], self.now)
            links = kept.where("session_id is not null").select(
                F.sha1(F.concat_ws("|", "session_id", "id")).alias("id"), F.col("session_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("relationship"),
                F.lit(1.0).alias("weight"), self.now.alias("created_at"),
            )
            edges = out["edges"].select(*links.columns).unionByName(links)
            self.tables.change(at, {"memories": out["memories"], "embeddings": out["embeddings"], "edges": edges, "entities": entities, "mentions": mentions})

        self._committed(work)
        return self.tables.read("memories", buckets=places).join(rows.select("id"), "id", "left_semi")

    def extract(self, conversations: DataFrame, project_id: str) -> DataFrame:
        """Memories out of ``conversations(conversation_id, text)``: rules, folding within each, then as ``store`` with folding into what is there."""
        rows = extract.fold_redundant(extract.rule_extract(conversations))
        new = rows.select("content", "type", F.lit(project_id).alias("project_id"), "tags")
        return self.store(new, fold=True)

    def query_batch(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Answers to ``queries(query_id, text, project_id)``, with context edges; reading counts nothing (see ``record_access``)."""
        k = top_k(k)
        t = self.tables.tables()
        asked = stored(queries.select("query_id", "text", F.when(F.col("project_id") != "", F.col("project_id")).alias("project_id")), "queries")
        vectors = self._vectors(asked.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
        names = extract.memory_entities(asked.select(F.col("query_id").alias("id"), F.col("text").alias("content"))).withColumnRenamed("id", "query_id")
        full = asked.join(vectors, "query_id", "left").join(names, "query_id", "left")
        rows = memories.current(t["memories"])
        ranked = retrieve.query_batch(full, rows, t["embeddings"], t["mentions"], t["edges"], self.now, self.config, k)
        out = ranked.join(rows.select("id", "content", "type", "project_id", "tags"), "id")
        return retrieve.with_context(out, t["edges"], rows)

    def query(self, text: str, project_id: str | None = None, k: int = 5, types: list[str] | None = None) -> DataFrame:
        """One question; ``types`` is an opt-in filter of the results, unknown types are ignored."""
        one = self.spark.createDataFrame([("q", text, project_id or "")], "query_id string, text string, project_id string")
        return memories.of_types(self.query_batch(one, k), types).orderBy("rank")

    def record_access(self, results: DataFrame) -> None:
        """Count one read of every different memory in ``results``."""
        reads = results.select(F.col("id").alias("memory_id"), self.now.alias("at")).distinct()
        self._committed(lambda at: self.tables.change(at, {"access_log": reads}))

    def connect(self, new: DataFrame) -> DataFrame:
        """Add edges ``(from_id, to_id, relationship, weight)``; returns the effective ones, which may be older."""
        for r in new.select("relationship").distinct().limit(len(L.RELATIONSHIPS) + 1).collect():
            graph.check_relationship(r[0])
        keys = KEYS["edges"]

        def work(at: Snapshot) -> DataFrame:
            t = self.tables.tables(at)
            rows = new.withColumns({"id": F.sha1(F.concat_ws("|", "from_id", "to_id", "relationship")), "created_at": self.now}).select(*t["edges"].columns)
            effective = stored(graph.connect(rows, t["edges"], t["memories"])[1], "effective")
            self.tables.change(at, {"edges": effective.join(t["edges"].select(*keys), keys, "left_anti").select(*t["edges"].columns)})
            return effective

        return self._committed(work)

    def delete(self, ids: DataFrame) -> None:
        """Remove memories and what hangs on them: only the keys that go are written."""
        names = ("memories", "embeddings", "edges", "mentions", "entities")

        def work(at: Snapshot) -> None:
            places = self.tables.buckets(self.tables.read("memories", at).join(ids.select("id").distinct(), "id", "left_semi"))
            t = self.tables.tables(at, places)
            after = graph.delete(ids, t)
            self.tables.change(at, {}, {n: t[n].select(*{*KEYS[n], PLACE[n]}).join(after[n].select(*KEYS[n]), KEYS[n], "left_anti") for n in names})

        self._committed(work)

    def graph(self, ident: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        t = self.tables.tables()
        centre = self.spark.createDataFrame([(ident,)], "id string")
        return graph.subgraph(centre, t["edges"], memories.current(t["memories"]), depth)

    def profile(self, project_id: str, rows: int = 0, days: int = 0) -> DataFrame:
        return profile.profiles(memories.in_project(memories.current(self.tables.read("memories")), project_id), self.now, rows, days)

    def start_session(self, agent_id: str, project_id: str, ident: str) -> None:
        new = self.spark.createDataFrame([(ident, project_id, agent_id)], "id string, project_id string, agent_id string").withColumn("started_at", self.now)
        self._committed(lambda at: self.tables.change(at, {"sessions": profile.start_sessions(new, self.tables.read("sessions", at)).join(new.select("id"), "id", "left_semi")}))

    def end_session(self, ident: str) -> None:
        ends = self.spark.createDataFrame([(ident,)], "id string").withColumn("ended_at", self.now)
        self._committed(lambda at: self.tables.change(at, {"sessions": profile.end_sessions(ends, self.tables.read("sessions", at)).join(ends.select("id"), "id", "left_semi")}))

    def stats(self) -> DataFrame:
        t = self.tables.tables()
        return graph.counts(t["memories"], t["entities"], t["edges"], t["mentions"])

    def consolidate(self) -> DataFrame:
        """Merge, decay, prune; folds all deltas into new bases; returns the report ``(phase, n)``."""

        def work(at: Snapshot) -> DataFrame:
            t = self.tables.tables(at)
            t["memories"] = stored(graph.with_access(t["memories"], t["access_log"]), "counted")
            report = stored(maintain.consolidation_report(t, self.now, self.config), "report")
            after = maintain.consolidate(t, self.now, self.config)
            # The reads are in the counts now.
            names = ("memories", "embeddings", "edges", "mentions", "entities")
            self.tables.replace(at, {name: after[name] for name in names} | {"access_log": t["access_log"].limit(0), "sessions": t["sessions"]})
            return report

        return self._committed(work)

    def evaluate(self, questions: DataFrame, sources: DataFrame, evidence: DataFrame, k: int = 30) -> DataFrame:
        """Metrics of ``questions(question_id, category, question, project_id)`` in one job."""
        asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"), "project_id")
        ranked = self.query_batch(asked, k).select(F.col("query_id").alias("question_id"), "rank", "id")
        ranks = evaluate.first_ranks(ranked, sources, evidence)
        return evaluate.aggregate(evaluate.question_scores(ranks, known=sources.select("evidence_key")), questions)
