import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from loci.config import EngineConfig
from loci.engine import Engine
from loci.sources import conversations, vectors
from loci.streaming import ingest as streaming

CLOCK = dt.datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), EngineConfig(dim=64), now=CLOCK)
    rows = [
        ("The ledger service uses Postgres for storage", "semantic", "p"), ("Always run the migration before deploying", "procedural", "p"),
        ("Maria Lopez joined the Atlas team", "episodic", "p"), ("The ledger service uses Redis for caching", "semantic", "other"),
    ]
    e.store(spark.createDataFrame(rows, "content string, type string, project_id string"))
    return e


def test_store_checks_its_input(spark, engine):
    for row in (("", "semantic", "p"), ("x", "odd", "p"), ("x", "semantic", "")):
        with pytest.raises(ValueError):
            engine.store(spark.createDataFrame([row], "content string, type string, project_id string"))
    with pytest.raises(LookupError):
        engine.store(spark.createDataFrame([("x y z", "semantic", "p", "nope")], "content string, type string, project_id string, session_id string"))


def test_query_and_access(spark, engine):
    got = engine.query("Which storage does the ledger service use?", "p").collect()
    assert got[0]["content"].startswith("The ledger service uses Postgres") and got[0]["rank"] == 1
    assert all(r["project_id"] == "p" for r in got)
    assert [r["content"] for r in engine.query("Maria Lopez", "p", types=["episodic", "odd"]).collect()][:1] == ["Maria Lopez joined the Atlas team"]
    engine.record_access(engine.query("ledger", "p"))
    assert engine.tables.read("access_log").count() >= 1


def test_storing_again_adds_nothing(spark, engine):
    before = engine.tables.read("memories").count()
    engine.store(spark.createDataFrame([("the ledger service uses postgres for storage!", "semantic", "p")], "content string, type string, project_id string"))
    assert engine.tables.read("memories").count() == before


def test_connect_graph_delete(spark, engine):
    ids = [r["id"] for r in engine.tables.read("memories").where("project_id = 'p'").orderBy("content").collect()]
    new = spark.createDataFrame([(ids[0], ids[1], "caused_by", 0.0)], "from_id string, to_id string, relationship string, weight double")
    assert engine.connect(new).first()["weight"] == 1.0
    nodes, edges = engine.graph(ids[0])
    assert ids[1] in {r["id"] for r in nodes.collect()} and "caused_by" in {r["relationship"] for r in edges.collect()}
    with pytest.raises(ValueError):
        engine.connect(new.withColumn("relationship", F.lit("likes")))
    gone = spark.createDataFrame([(ids[1],), ("unknown",)], "id string")
    engine.delete(gone)
    assert ids[1] not in {r["id"] for r in engine.tables.read("memories").collect()}
    assert engine.tables.read("edges").where((F.col("from_id") == ids[1]) | (F.col("to_id") == ids[1])).count() == 0


def test_extract_twice(spark, engine):
    talk = spark.createDataFrame([("c", "User: I prefer short functions in Go.\nBot: ok\nUser: We migrated the billing cluster to Helm.")], "conversation_id string, text string")
    first = engine.extract(talk, "talks").count()
    engine.extract(talk, "talks")
    rows = engine.tables.read("memories").where("project_id = 'talks'").collect()
    assert first == 2 and len(rows) == 2 and max(r["access_count"] for r in rows) >= 1


def test_sessions_profile_stats_consolidate(spark, engine):
    engine.start_session("agent", "p", "s1")
    engine.end_session("s1")
    with pytest.raises(ValueError):
        engine.end_session("s1")
    assert {r["section"] for r in engine.profile("p").collect()} <= {"static", "dynamic"}
    stats = engine.stats().first()
    assert stats["nodes"] > 0
    report = {r["phase"]: r["n"] for r in engine.consolidate().collect()}
    assert set(report) == {"merged", "decayed", "pruned"} and report["pruned"] == 0
    assert engine.tables.read("access_log").count() == 0


def test_stream_ingest(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    rows = [("The stream writes memories in batches", "semantic", "s"), ("The stream writes memories in batches", "semantic", "s")]
    frame = spark.createDataFrame(rows, "content string, type string, project_id string")
    frame.limit(1).write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    streaming.ingest_stream(stream, engine, str(tmp_path / "cp")).awaitTermination(120)
    frame.limit(1).write.mode("append").parquet(source)
    streaming.ingest_stream(stream, engine, str(tmp_path / "cp")).awaitTermination(120)
    assert engine.tables.read("memories").where("project_id = 's'").count() == 1


def test_windowed_counts(spark):
    at = dt.datetime(2026, 1, 1, 10, 2)
    events = spark.createDataFrame([(at, "a"), (at + dt.timedelta(minutes=1), "a"), (at + dt.timedelta(minutes=9), "a")], "ts timestamp, kind string")
    assert sorted(r["n"] for r in streaming.windowed_counts(events, "ts", "kind").collect()) == [1, 2]


def test_conversation_files(spark, tmp_path):
    data = [{
        "sample_id": "c1",
        "conversation": {
            "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "Hello\nthere"}], "session_1_date_time": "1:56 pm on 8 May, 2023",
            "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "Hi"}], "session_2_date_time": "not a time", "session_4": [{"speaker": "B", "dia_id": "D4:1", "text": "gap"}], "session_4_date_time": "1:56 pm on 9 May, 2023",
        },
        "qa": [{"question": "q?", "answer": "a", "evidence": ["D1:1; D01:01"], "category": 4}, {"question": "r?", "answer": 7, "evidence": [], "category": 5, "adversarial_answer": "x"}],
    }]
    path = str(tmp_path / "talks.json")
    with open(path, "w") as f:
        json.dump(data, f)
    turns, questions = conversations.load(spark, path)
    rows = turns.collect()
    assert [r["dia_id"] for r in rows] == ["D1:1"] and rows[0]["content"] == "On 1:56 pm on 8 May, 2023, A said that Hello there"
    q = {r["id"]: r for r in questions.collect()}
    assert q["c1-q0"]["category"] == "single-hop" and q["c1-q0"]["evidence"] == ["D1:1"] and q["c1-q1"]["answer"] == "7"
    corpus = conversations.turns_corpus(turns).first()
    assert corpus["sources"] == ["c1/D1:1"] and corpus["created_at"] == dt.datetime(2026, 8, 30, 10, 1)
    pinned = str(tmp_path / "pinned.json")
    with open(pinned, "w") as f:
        json.dump(["c1-q1"], f)
    assert [r["id"] for r in conversations.load_pinned(spark, pinned, questions).collect()] == ["c1-q1"]
    with open(pinned, "w") as f:
        json.dump(["nope"], f)
    with pytest.raises(ValueError):
        conversations.load_pinned(spark, pinned, questions)


def test_vector_fixture(spark, tmp_path):
    import hashlib

    key = lambda t: hashlib.sha256(t.encode()).digest()
    path = str(tmp_path / "v.bin")
    vectors.write_fixture({key("b"): [1.0, 2.0], key("a"): [3.0, 4.0]}, path)
    assert not os.path.exists(path + ".part")
    fixture = vectors.read_fixture(spark, path)
    assert {bytes(r["text_sha"]): list(r["embedding"]) for r in fixture.collect()} == {key("b"): [1.0, 2.0], key("a"): [3.0, 4.0]}
    texts = spark.createDataFrame([("a",), ("zz",)], "text string")
    assert {r["text"]: r["embedding"] for r in vectors.looked_up(texts, fixture).collect()} == {"a": [3.0, 4.0], "zz": None}
    assert vectors.misses(texts, fixture) == 1
    with pytest.raises(ValueError):
        vectors.write_fixture({key("a"): [1.0], key("b"): [1.0, 2.0]}, path)
    with open(path, "wb") as f:
        f.write(b"nonsense")
    with pytest.raises(Exception, match="fixture"):
        vectors.read_fixture(spark, path).collect()


def test_embedding_provider_survives_bad_texts(spark):
    from loci.operators.embed import embed_with

    class Picky:
        dim = 1

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("1", "abc"), ("2", "bad"), ("3", None)], "id string, text string")
    assert {r["id"]: r["embedding"] for r in embed_with(rows, Picky).collect()} == {"1": [3.0], "2": None, "3": [0.0]}


def _files(engine, name):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{engine.tables.path}/{name}") for f in fs if f.endswith(".parquet")}


def test_one_row_writes_its_bucket_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), EngineConfig(dim=64), now=CLOCK)
    kind = "content string, type string, project_id string"
    e.store(spark.createDataFrame([(f"The service number {i} uses Postgres for storage", "semantic", f"p{i}") for i in range(6)], kind))
    before = {n: _files(e, n) for n in ("memories", "embeddings", "edges", "entities", "mentions")}
    # New, then the same with more words: the stored row is updated by a row of its bucket.
    e.store(spark.createDataFrame([("Maria Lopez moved to the Atlas team", "semantic", "p1")], kind))
    new = _files(e, "memories") - before["memories"]
    assert len({os.path.basename(os.path.dirname(f)) for f in new}) == 1 and spark.read.parquet(*new).count() == 1
    assert all(before[n] <= _files(e, n) for n in before)
    e.store(spark.createDataFrame([("the service number 1 uses postgres for storage!", "semantic", "p1")], kind))
    rows = {r["project_id"]: r for r in e.tables.read("memories").where("content like '%number%'").collect()}
    assert len(rows) == 6 and rows["p1"]["access_count"] == 1 and rows["p2"]["access_count"] == 0
    total = e.tables.read("memories").count()
    e.consolidate()
    assert len(e.tables.snapshot().folders["memories"]) == 1 and e.tables.read("memories").count() == total


def test_commits_are_whole_and_exclusive(spark, tmp_path):
    from loci.sources.store import Conflict, Store

    s = Store(spark, str(tmp_path / "s")).init()
    row = lambda i, n: spark.createDataFrame([(i, "p", None, None, None)], "id string, project_id string, agent_id string, started_at timestamp, ended_at timestamp").withColumn("agent_id", F.lit(n))
    at = s.snapshot()
    s.change(at, {"sessions": row("a", "one")})
    with pytest.raises(Conflict):
        s.change(at, {"sessions": row("b", "late")})
    assert {r["id"]: r["agent_id"] for r in s.read("sessions").collect()} == {"a": "one"}
    # A reader keeps its snapshot; a half-written commit file is passed over.
    then = s.snapshot()
    s.change(then, {"sessions": row("a", "two").unionByName(row("c", "three"))}, {})
    assert {r["agent_id"] for r in s.read("sessions", then).collect()} == {"one"}
    with open(f"{s.path}/_commits/{9:010d}.json", "w") as f:
        f.write('{"tables": {"sess')
    assert {r["agent_id"] for r in s.read("sessions").collect()} == {"two", "three"}
    os.remove(f"{s.path}/_commits/{9:010d}.json")
    s.change(s.snapshot(), {}, {"sessions": row("c", "x").select("id")})
    assert {r["id"] for r in s.read("sessions").collect()} == {"a"}
    assert s.read("memories").count() == 0 and s.ping()
