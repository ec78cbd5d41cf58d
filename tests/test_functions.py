import datetime as dt

import pytest
from pyspark.sql import functions as F

from loci.config import EngineConfig, pools, top_k
from loci.functions import scoring as S
from loci.functions import text as X
from loci.functions import vector as V
from loci.functions.english import analyse, stem
from loci.functions.entities import find_entities, plausible
from loci.sources import conversations


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_tokens_and_hash(spark):
    assert one(spark, X.content_tokens(F.col("t")), t='  "Hello,  (World)!" -- x ') == ["hello", "world", "--", "x"]
    assert one(spark, X.content_hash(F.col("t")), t="  Caroline   is  transgender!  ") == "c052edbb391ee1d2c12459258da2d16b"
    assert one(spark, X.content_hash(F.col("t")), t=" ... ") == ""
    assert one(spark, X.content_hash(F.col("t")), t=None) == ""
    assert one(spark, X.content_tokens(F.col("t")), t=None) is None
    assert len(one(spark, X.content_tokens(F.col("t")), t="w " * 50_000)) == 50_000


def test_fnv(spark):
    assert one(spark, X.fnv1a32(F.col("t")), t="database") == 2707807672
    assert one(spark, X.fnv1a32(F.col("t")), t="") == 2166136261


def test_keywords_keep_repeats_and_count_bytes(spark):
    assert one(spark, X.keywords(F.col("t")), t="What is the cache, Cache? é x") == ["cache", "cache", "é"]


@pytest.mark.parametrize("name,key", [("Acme's", "acme"), ("  The  Board. ", "the board"), ("“Rust”", "rust"), ("Bob’s", "bob")])
def test_entity_names(spark, name, key):
    assert one(spark, X.normalize_entity(F.col("t")), t=name) == key


def test_utterances_and_speaker(spark):
    assert one(spark, X.utterances(F.col("t")), t="User: I like tea. Bot: Fine!\n\nUser: ok") == ["User: I like tea.", "Bot: Fine!", "User: ok"]
    assert one(spark, X.strip_speaker(F.col("t")), t="User: a: b") == "a: b"
    long = "x" * 40 + ": y"
    assert one(spark, X.strip_speaker(F.col("t")), t=long) == long


@pytest.mark.parametrize(
    "text,kind,tag",
    [
        ("I prefer tabs over spaces", "semantic", "preference"),
        ("Always run the tests first", "procedural", "workflow"),
        ("We migrated the ledger", "episodic", "event"),
        ("The cache is in Redis", "semantic", None),
        ("thanks", None, None),
        ("Nothing here that matches any of the rules", "episodic", None),
        ("short but no rule", None, None),
    ],
)
def test_rules(spark, text, kind, tag):
    r = one(spark, X.classified(F.col("t")), t=text)
    assert (r["type"], r["tag"]) == (kind, tag)


@pytest.mark.parametrize(
    "new,old,verdict",
    [
        ("the build runs on linux", "The build runs on Linux.", "equivalent"),
        ("the nightly build runs on linux", "the build runs on linux", "new_subsumes_old"),
        ("the build runs", "the build now runs daily", "old_subsumes_new"),
        ("the build never runs on linux", "the build runs on linux", "distinct"),
        ("a b", "a b", "distinct"),
        ("on linux runs the build", "the build runs on linux", "distinct"),
    ],
)
def test_subsumption(spark, new, old, verdict):
    assert one(spark, X.subsumes(X.content_tokens(F.col("a")), X.content_tokens(F.col("b"))), a=new, b=old) == verdict


@pytest.mark.parametrize(
    "new,old,tags,confidence",
    [
        ("We switched to Postgres for the ledger", "The ledger uses MySQL for the ledger", [], 0.9),
        ("the gateway uses redis", "the gateway uses kafka", [], 0.85),
        ("the gateway uses redis cluster", "the gateway uses redis", [], None),
        ("we never deploy the gateway on friday", "we deploy the gateway on friday", [], 0.8),
        ("tea is nice", "rust compiles code", [], None),
    ],
)
def test_contradiction(spark, new, old, tags, confidence):
    row = spark.createDataFrame([(new, old, tags, tags)], "a string, b string, x array<string>, y array<string>")
    r = row.select(X.contradiction(X.contradiction_features(F.col("a"), F.col("x")), X.contradiction_features(F.col("b"), F.col("y"))).alias("r")).first()["r"]
    assert (r and r["confidence"]) == confidence


def test_tags(spark):
    row = spark.createDataFrame([(["Go", "x", " "], ["go", "Y"])], "a array<string>, b array<string>")
    r = row.select(X.tags_union(F.col("a"), F.col("b")).alias("u"), X.tag_ratio(F.col("a"), F.col("b")).alias("t")).first()
    assert r["u"] == ["Go", "x", "Y"] and r["t"] == 0.5


def test_evidence_and_urls(spark):
    assert one(spark, X.evidence_keys(F.col("t")), t="D1:03; D01:3, D12:1") == ["D1:3", "D12:1"]
    assert one(spark, X.redacted_url(F.col("t")), t="https://a:b@h/x?key=1&q=2") == "https://REDACTED@h/x?key=REDACTED&q=2"
    assert one(spark, X.without_fence(F.col("t")), t="```json\n[1]\n```") == "[1]"


def test_clamp_and_gate(spark):
    assert one(spark, S.clamp01(F.col("x")), x=float("nan")) == 0.0
    assert one(spark, S.clamp01(F.col("x")), x=-3.0) == 0.0
    assert one(spark, S.clamp01(F.col("x")), x=3.0) == 1.0
    assert one(spark, S.gate(F.lit(False), F.col("x")), x=0.1) is False
    assert one(spark, S.gate(F.lit(False), F.col("x").cast("double")), x=None) is True


def test_rank_normal_is_monotone_and_bounded(spark):
    rows = spark.createDataFrame([(float(i) / 10,) for i in range(100)], "x double").select(S.rank_normal(F.col("x"), F.lit(3)).alias("s")).collect()
    values = [r["s"] for r in rows]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


def score(spark, relevance, days, count=0, kind="semantic", superseded=False):
    now = dt.datetime(2026, 1, 1)
    row = spark.createDataFrame([(relevance, now, now - dt.timedelta(days=days), count, kind, superseded)], "r double, n timestamp, c timestamp, k bigint, t string, s boolean")
    return row.select(S.final_score(F.col("r"), F.col("n"), F.col("c"), F.col("k"), F.col("t"), F.col("s")).alias("x")).first()["x"]


def test_recency_breaks_ties_but_does_not_overturn_relevance(spark):
    assert score(spark, 0.9, 700) > score(spark, 0.5, 0)
    assert score(spark, 0.5, 1) > score(spark, 0.5, 100)


def test_superseded_loses_to_its_successor(spark):
    assert score(spark, 0.8, 10, superseded=True) < score(spark, 0.8, 10)
    assert score(spark, 0.9, 10, superseded=True) > score(spark, 0.0, 10)


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], [0.0, 0.0], [float("nan"), 1.0])], "a array<float>, b array<float>, z array<float>, n array<float>")
    r = row.select(
        V.cosine(F.col("a"), F.col("b")).alias("cos"), V.cosine(F.col("a"), F.col("z")).alias("with_zero"), V.is_zero(F.col("z")).alias("zero"), V.is_usable(F.col("n"), 2).alias("nan"),
        V.l2_normalized(F.col("z")).alias("same"),
    ).first()
    assert abs(r["cos"] - 0.8) < 1e-9 and r["with_zero"] is None and r["zero"] and not r["nan"] and list(r["same"]) == [0.0, 0.0]


def test_entities():
    assert find_entities('We met "Project Atlas" and Maria Lopez in Oslo. The Board agreed on Monday.') == ["Project Atlas", "Maria Lopez", "Oslo", "Board"]
    assert find_entities("") == [] and find_entities(None) == []
    assert not plausible("Twelve") and not plausible("2024") and not plausible("x") and plausible("Kafka 3")


def test_stems():
    assert [stem(w) for w in ("running", "hoping", "hopping", "skies", "relational", "databases")] == ["run", "hope", "hop", "sky", "relat", "databas"]
    assert analyse("The caches are running") == ["cach", "run"]


def test_session_time(spark):
    parsed = one(spark, conversations.session_time(F.col("t")), t="1:56 PM on 8 May, 2023")
    assert parsed == dt.datetime(2023, 5, 8, 13, 56)
    assert one(spark, conversations.session_time(F.col("t")), t="12:05 am on 31 december, 2023") == dt.datetime(2023, 12, 31, 0, 5)
    assert one(spark, conversations.session_time(F.col("t")), t="yesterday") is None
    assert one(spark, conversations.session_time(F.col("t")), t="1:00 pm on 31 Feb, 2023") is None


def test_uuid5(spark):
    import uuid

    made = one(spark, conversations.uuid5(conversations.NAMESPACE, F.col("t")), t="conv/D1:2")
    assert made == str(uuid.uuid5(uuid.UUID(conversations.NAMESPACE), "conv/D1:2"))


def test_config_names_every_problem():
    with pytest.raises(ValueError) as e:
        EngineConfig(dim=0, fusion="max", half_life_days=0).validate()
    assert "dim" in str(e.value) and "fusion" in str(e.value) and "half_life" in str(e.value)
    assert top_k(0) == 5 and top_k(500) == 200 and pools(5) == (50, 50, 25) and pools(1000) == (500, 200, 100)


def test_names_as_written_and_one_opener_dropped():
    from loci.functions.entities import find_entities

    assert find_entities("The Bank of England refused. Caroline's dog met Caroline") == ["Bank of England", "Caroline's"]
    assert find_entities('we read "Charlotte\'s Web" with Maria on Monday') == ["Charlotte's Web", "Maria"]
    assert find_entities("In May 42 people came") == [] and find_entities("") == [] and find_entities(None) == []


def test_triples_leave_out_words_of_one_byte(spark):
    rows = spark.createDataFrame([("caroline has a dog now",), ("caroline has dog now",)], "t string").select(X.triples(F.col("t")).alias("r")).collect()
    assert [(t["verb"], t["subject"], list(t["object"])) for r in rows for t in r["r"]] == [("has", "caroline", ["dog", "now"])] * 2


def test_topics_trim_slashes_and_dashes(spark):
    assert spark.createDataFrame([("docker/ and go- with (redis)",)], "t string").select(X.topics(F.col("t")).alias("r")).first()["r"] == ["docker", "go", "redis"]
