import datetime as dt

import pytest
from pyspark.sql import functions as F

from loci import schema
from loci.operators import embed, evaluate, extract, graph, ingest, maintain, memories, profile, retrieve, skew

T0 = dt.datetime(2026, 1, 1)

def now():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")



def mem(spark, *rows):
    """Rows of (id, content, type, project, tags, day, access)."""
    full = [(i, c, t, p, g, T0 + dt.timedelta(days=d), a, 1.0, None) for i, c, t, p, g, d, a in rows]
    return spark.createDataFrame(full, schema.MEMORIES)


def edg(spark, *rows):
    return spark.createDataFrame([(f"{a}-{b}-{r}", a, b, r, w, T0 + dt.timedelta(days=d)) for a, b, r, w, d in rows], schema.EDGES)


def test_key_results_with_nulls_ties_and_clashing_columns(spark):
    rows = [("a", 1)] * 500 + [("a", 2)] * 500 + [("b", None), (None, 7), ("c", 3), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v bigint").withColumns({"n": F.lit("x"), "value": F.lit(0), "total": F.lit(0), "__key": F.lit(1)})
    got = {r["k"]: tuple(r)[1:] for r in skew.key_counts(df, "k", "v").collect()}
    assert got == {"a": (1000, 2, 1, 500), "b": (1, 0, None, None), None: (1, 1, 7, 1), "c": (2, 1, 3, 1)}
    p = {(r["k"], r["share"]): r["percentile"] for r in skew.key_percentiles(df, "k", "v", [0.5, 0.51, 1.0], ranges=4).collect()}
    assert p[("a", 0.5)] == 1.0 and p[("a", 0.51)] == 2.0 and p[("a", 1.0)] == 2.0 and ("b", 0.5) not in p and p[(None, 0.5)] == 7.0
    assert [r["k"] for r in skew.heavy_values(df, "k", "v", 0.5).collect()] == ["a"]


def test_key_percentiles_match_sorting(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("xyz"), rng.choice([rng.random(), 0.25])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["share"]): r["percentile"] for r in skew.key_percentiles(df, "k", "v", [0.1, 0.5, 0.99]).collect()}
    for k in {"hot", "x", "y", "z"}:
        values = sorted(v for a, v in rows if a == k)
        for q in (0.1, 0.5, 0.99):
            assert got[(k, q)] == values[max(1, math.ceil(q * len(values))) - 1]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v bigint")
    assert skew.key_counts(df, "k", "v").count() == 0
    assert skew.key_percentiles(df, "k", "v", [0.5]).count() == 0
    assert skew.heavy_values(df, "k", "v", 0.1).count() == 0
    m = spark.createDataFrame([], schema.MEMORIES)
    e = spark.createDataFrame([], schema.EDGES)
    assert memories.current(m).count() == 0 and graph.clean_edges(e).count() == 0 and maintain.merges(m).count() == 0


def test_rows_delivered_again_and_dirty_fields(spark):
    rows = mem(spark, ("a", "x", " Semantic", "p", None, 0, 1), ("a", "x", " Semantic", "p", None, 0, 3), ("b", None, "odd", None, ["t"], 0, None))
    got = {r["id"]: r for r in memories.current(rows.withColumn("decay_score", F.lit(0.0))).collect()}
    assert got["a"]["access_count"] == 3 and got["a"]["type"] == "semantic" and got["a"]["tags"] == [] and got["a"]["decay_score"] == 1.0
    assert got["b"]["type"] is None and got["b"]["access_count"] == 0


def test_edges_keep_the_first_write(spark):
    m = mem(spark, ("a", "x", "semantic", "p", [], 0, 0), ("b", "y", "semantic", "p", [], 0, 0))
    first = graph.add_edges(edg(spark, ("a", "b", "relates_to", 0.3, 1), ("a", "b", "relates_to", 0.9, 2), ("a", "zz", "relates_to", 0.9, 2), ("a", "b", "odd", 1.0, 0)), edg(spark), m)
    assert [(r["weight"], r["to_id"]) for r in first.collect()] == [(0.3, "b")]
    again = graph.add_edges(edg(spark, ("a", "b", "relates_to", 0.8, 9)), first, m)
    assert [r["weight"] for r in again.collect()] == [0.3]
    _, effective = graph.connect(edg(spark, ("a", "b", "relates_to", -1.0, 9)), first, m)
    assert [r["weight"] for r in effective.collect()] == [0.3]
    with pytest.raises(LookupError):
        graph.connect(edg(spark, ("a", "nobody", "relates_to", 1.0, 9)), first, m)
    with pytest.raises(ValueError):
        graph.check_relationship("likes")


def test_neighbours(spark):
    e = edg(spark, ("a", "b", "relates_to", 1.0, 0), ("c", "b", "relates_to", 1.0, 0), ("d", "d", "relates_to", 1.0, 0))
    c = spark.createDataFrame([("a",), ("d",), ("q",)], "id string")
    one = {(r["centre"], r["id"]) for r in graph.neighbours(c, e).collect()}
    assert one == {("a", "b"), ("d", "d")}
    two = {(r["centre"], r["id"], r["distance"]) for r in graph.neighbours(c, e, 2).collect()}
    assert ("a", "c", 2) in two and ("a", "b", 1) in two


def test_delete_takes_orphans(spark):
    m = mem(spark, ("a", "x", "semantic", "p", [], 0, 0), ("b", "y", "semantic", "p", [], 0, 0))
    men = spark.createDataFrame([("a", "solo", "p", 1.0, T0), ("a", "both", "p", 1.0, T0), ("b", "both", "p", 1.0, T0)], schema.MENTIONS)
    ent = spark.createDataFrame([("1", "Solo", "solo", "p"), ("2", "Both", "both", "p"), ("3", "Solo", "solo", "other")], schema.ENTITIES)
    emb = spark.createDataFrame([("a", "p", [1.0], T0)], schema.EMBEDDINGS)
    gone = spark.createDataFrame([("a",), ("unknown",)], "id string")
    out = graph.delete(gone, {"memories": m, "embeddings": emb, "edges": edg(spark, ("a", "b", "relates_to", 1.0, 0)), "mentions": men, "entities": ent})
    assert [r["id"] for r in out["memories"].collect()] == ["b"] and out["edges"].count() == 0 and out["embeddings"].count() == 0
    assert sorted(r["id"] for r in out["entities"].collect()) == ["2", "3"]


def test_compare_and_swap(spark):
    from loci.functions import text as X

    m = mem(spark, ("a", "old text here", "semantic", "p", [], 0, 0)).withColumn("content_hash", X.content_hash(F.col("content")))
    h = m.first()["content_hash"]
    change = spark.createDataFrame([("a", h, "new text")], "id string, expected_hash string, new_content string")
    after = graph.update_content(change, m)
    assert after.first()["content"] == "new text" and after.first()["content_hash"] != h
    assert graph.update_content(change, after).first()["content"] == "new text"
    with pytest.raises(ValueError):
        graph.update_content(change.withColumn("expected_hash", F.lit("zz")), m).collect()


def test_upsert_refuses_bad_vectors(spark):
    old = spark.createDataFrame([("a", "p", [1.0, 0.0], T0)], schema.EMBEDDINGS)
    new = spark.createDataFrame([("a", "p", [0.0, 0.0], T0), ("b", "p", [0.0, 2.0], T0), ("c", "p", [1.0], T0), ("d", "p", [float("nan"), 1.0], T0)], schema.EMBEDDINGS)
    assert sorted(r["memory_id"] for r in graph.upsert_embeddings(new, old, 2).collect()) == ["a", "b"]


def test_rare_terms_outrank_common_ones_and_tags_are_searched(spark):
    rows = [(f"m{i}", "the cache is warm", "semantic", "p", [], i, 0) for i in range(8)] + [("rare", "the zebra is warm", "semantic", "p", [], 0, 0), ("tag", "nothing", "semantic", "p", ["Zebra"], 0, 0), ("inside", "zebrawood", "semantic", "p", [], 0, 0)]
    m = memories.current(mem(spark, *rows))
    q = spark.createDataFrame([("q", "p", "zebra cache")], "query_id string, project_id string, text string")
    posted = retrieve.postings(m)
    terms = retrieve.query_terms(q)
    w = retrieve.term_weights(terms, posted, m)
    got = [r["id"] for r in retrieve.keyword_pool(terms, w, posted, F.lit(50)).orderBy("kw_rank").collect()]
    assert got[:2] == ["rare", "tag"] and "inside" not in got


def test_query_batch_with_fallback_and_other_project(spark):
    m = memories.current(mem(spark, ("a", "redis holds the cache", "semantic", "p", [], 1, 0), ("b", "kafka holds events", "semantic", "p", [], 2, 0), ("c", "redis too", "semantic", "other", [], 3, 0)))
    q = spark.createDataFrame([("1", "redis", "p"), ("2", "what is it", "p"), ("3", "redis", None), ("4", "unknownword", "p")], "query_id string, text string, project_id string")
    got = retrieve.query_batch(q, m, None, None, edg(spark), now()).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["relevance"]))
    assert [x[1] for x in sorted(by["1"])] == ["a"]
    assert [x[1] for x in sorted(by["2"])] == ["b", "a"] and all(x[2] == 0 for x in by["2"])
    assert {x[1] for x in by["3"]} == {"a", "c"} and "4" not in by


def test_entity_hop_reaches_memories_without_common_words(spark):
    m = memories.current(mem(spark, ("a", "it went down again", "semantic", "p", [], 1, 0), ("b", "it went down again", "semantic", "x", [], 1, 0)))
    men = spark.createDataFrame([("a", "atlas", "p"), ("b", "atlas", "x")], "memory_id string, normalized_name string, project_id string")
    q = spark.createDataFrame([("1", "atlas", "p", ["Atlas"])], "query_id string, text string, project_id string, entities array<string>")
    got = retrieve.query_batch(q, m, None, men, edg(spark), now()).collect()
    assert [r["id"] for r in got] == ["a"] and got[0]["relevance"] > 0


def test_vector_only_candidates_need_the_gate(spark):
    m = memories.current(mem(spark, ("near", "aa", "semantic", "p", [], 1, 0), ("far", "bb", "semantic", "p", [], 1, 0)))
    emb = spark.createDataFrame([("near", "p", [1.0, 0.1]), ("far", "p", [0.1, 1.0]), ("zero", "p", [0.0, 0.0])], "memory_id string, project_id string, embedding array<float>")
    q = spark.createDataFrame([("1", "zzz", "p", [1.0, 0.0])], "query_id string, text string, project_id string, embedding array<float>")
    from loci.config import EngineConfig

    got = retrieve.query_batch(q, m, emb, None, edg(spark), now(), EngineConfig(dim=2)).collect()
    assert [r["id"] for r in got] == ["near"]


def test_context_lists_outgoing_edges_first(spark):
    m = mem(spark, ("a", "A", "semantic", "p", [], 0, 0), ("b", "B", "semantic", "p", [], 0, 0), ("c", "C", "semantic", "p", [], 0, 0))
    e = edg(spark, ("b", "a", "relates_to", 0.5, 0), ("a", "c", "supersedes", 1.0, 0))
    ids = spark.createDataFrame([("a",)], "id string")
    got = retrieve.with_context(ids, e, m).first()["context"]
    assert [(x["relationship"], x["target_id"], x["target_content"]) for x in got] == [("supersedes", "c", "C"), ("relates_to", "b", "B")]


def test_extraction_and_folding(spark):
    text = "User: I prefer tabs over spaces.\nBot: ok\nUser: I prefer tabs over spaces.\nUser: I really prefer tabs over spaces.\nUser: I never prefer tabs over spaces."
    c = spark.createDataFrame([("c", text), ("n", None), ("e", "")], "conversation_id string, text string")
    rows = extract.rule_extract(c)
    assert sorted(r["content"] for r in rows.collect()) == ["I never prefer tabs over spaces.", "I prefer tabs over spaces.", "I really prefer tabs over spaces."]
    folded = {r["content"]: r["folded"] for r in extract.fold_redundant(rows).collect()}
    assert folded == {"I really prefer tabs over spaces.": 1, "I never prefer tabs over spaces.": 0}


def test_store_twice_adds_nothing_and_denials_stay_apart(spark):
    m = mem(spark, ("a", "the build runs on linux", "semantic", "p", ["ci"], 0, 0))
    emb = spark.createDataFrame([("a", "p", [1.0, 0.0], T0)], schema.EMBEDDINGS)
    new = mem(spark, ("n1", "The build runs on Linux!", "semantic", "p", ["ci"], 9, 0), ("n2", "the build never runs on linux", "semantic", "p", ["CI"], 9, 0), ("n3", "the nightly build runs on linux", "semantic", "p", [], 9, 0))
    new = new.join(spark.createDataFrame([("n1", [1.0, 0.0]), ("n2", [0.9, 0.1]), ("n3", [0.95, 0.05])], "id string, embedding array<float>"), "id")
    out = ingest.store(new, m, emb, edg(spark), 2, now())
    rows = {r["id"]: r for r in out["memories"].collect()}
    assert set(rows) == {"a", "n2"} and rows["a"]["content"] == "the nightly build runs on linux" and rows["a"]["access_count"] == 2
    made = {(r["from_id"], r["to_id"], r["relationship"]) for r in out["edges"].collect()}
    assert all(a != b for a, b, _ in made)


def test_consolidation_is_idempotent(spark):
    m = mem(spark, ("a", "same", "semantic", "p", [], 1, 0), ("b", "same", "semantic", "p", [], 5, 0), ("c", "same", "semantic", "q", [], 5, 0), ("d", "same", "episodic", "p", [], 5, 0))
    e = maintain.merge_phase(m, edg(spark), now())
    assert [(r["from_id"], r["to_id"]) for r in e.collect()] == [("b", "a")]
    assert maintain.merge_phase(m, e, now()).count() == 1
    assert maintain.degraded(2, 10) and not maintain.degraded(1, 10) and not maintain.degraded(0, 0)


def test_prune_needs_all_three_signs(spark):
    m = mem(spark, ("old", "x", "semantic", "p", [], -400, 0), ("read", "x", "semantic", "p", [], -400, 5), ("new", "x", "semantic", "p", [], 150, 0))
    aged = maintain.decay_phase(m, now())
    assert [r["id"] for r in maintain.stale(aged, now()).collect()] == ["old"]


def test_profile_sections(spark):
    m = mem(spark, ("s", "x", "semantic", "p", [], 0, 0), ("d", "x", "episodic", "p", [], 150, 0), ("o", "x", "episodic", "p", [], 10, 0))
    got = {r["id"]: r["section"] for r in profile.profiles(m, now(), 0, 7).collect()}
    assert got == {"s": "static", "d": "dynamic"}
    assert profile.profile_totals(m).first()["total"] == 3


def test_sessions(spark):
    none = spark.createDataFrame([], schema.SESSIONS)
    new = spark.createDataFrame([("s", "p", "agent", T0)], "id string, project_id string, agent_id string, started_at timestamp")
    one = profile.start_sessions(new, none)
    end = spark.createDataFrame([("s", T0 + dt.timedelta(hours=1))], "id string, ended_at timestamp")
    done = profile.end_sessions(end, one)
    assert done.first()["ended_at"] == T0 + dt.timedelta(hours=1)
    with pytest.raises(ValueError):
        profile.end_sessions(end, done)
    with pytest.raises(LookupError):
        profile.end_sessions(end.withColumn("id", F.lit("x")), one)
    with pytest.raises(ValueError):
        profile.start_sessions(new.withColumn("agent_id", F.lit("")), none)


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 12, "c"), ("z", 1, "a")], "question_id string, rank int, id string")
    sources = spark.createDataFrame([("b", "k1"), ("c", "k2"), ("a", "other")], "id string, evidence_key string")
    evidence = spark.createDataFrame([("q", "k1"), ("q", "k2"), ("q", "absent"), ("z", "absent")], "question_id string, evidence_key string")
    s = evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence), known=sources.select("evidence_key")).collect()
    assert len(s) == 1 and s[0]["hit"] == 1.0 and s[0]["recall"] == 0.5 and s[0]["full"] == 0.0 and s[0]["mrr"] == 0.5
    q = spark.createDataFrame([("q", "temporal"), ("z", "adversarial")], "question_id string, category string")
    m = {r["category"]: (r["n"], r["unscorable"]) for r in evaluate.aggregate(evaluate.question_scores(evaluate.first_ranks(ranked, sources, evidence), known=sources.select("evidence_key")), q).collect()}
    assert m == {"temporal": (1, 0), "adversarial": (0, 1), "all": (1, 1), "answerable": (1, 0)}
    assert evaluate.digest(ranked).first()["digest"] == evaluate.digest(ranked.repartition(3)).first()["digest"]


def test_bag_of_words_is_unit_length_and_blank_texts_are_zero(spark):
    rows = spark.createDataFrame([("a", "red green blue green"), ("b", "the of"), ("c", "")], "id string, text string")
    cells = embed.sparse(rows, 64)
    assert {r["id"] for r in cells.collect()} == {"a"}
    v = embed.dense(cells, 64).first()["embedding"]
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_schema_errors_are_named(spark):
    with pytest.raises(ValueError) as e:
        schema.validate_schema(spark.createDataFrame([(1,)], "id int"), schema.ENTITIES)
    assert "id: int instead of string" in str(e.value) and "name: missing" in str(e.value)
    bad = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="width"):
        schema.check_dimension(bad, 3).collect()
