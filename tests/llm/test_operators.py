import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loci.llm import leakage, leximin, neardup, packing, parsimony, pii, truncation, vectors
from loci.llm.words import edge_words, run_words

RNG = random.Random(11)
WORDS = [a + b for a, b in itertools.product("ba be bi bo bu da de di do du ka ke ki ko ku".split(), "lan mor tis vek rup sel non".split())]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


# --- 1 personal data ---------------------------------------------------------------------------

LEXICON = pii.Lexicon([(f, "family") for f in "Soquist Lenquist Morquist Tanholt Verholt Garholt Burley Hanley Manley Field".split()] + [(g, "given") for g in "Mira Dorya Tonya Fanya Lilel Torel Gunel".split()])


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail a.b+c@x-y.example.com or d_e (at) x (dot) test, f AT g DOT example", ["email"] * 3),
        ("BILLING@HOLRON.EXAMPLE <mailto:x@y.test>", ["email", "email"]),
        ("Pinned mules@6.4.12, retry@2x, @someone, https://h.example/a?b=c", []),
        ("call 229-555-0199 ext. 96, +44 20 7946 0828, 07700 900086, 030/23125-682, 01 99 00 57 30, (986) 555 0191, +1.223.555.0150", ["phone"] * 7),
        ("Order 227-6072-191, Ticket 9398201915, Host 10.12.33.249, Build 2025.10.25-810, Ratio 0.5567-92, Trace id 570704232785", []),
        ("SSN 967-52-0456; aadhaar 0157-7596-3496; PAN ZDENU6145F; passport no. NV747805; NI number ZZ63 47 03 S", ["identity_number"] * 5),
        ("ID card 28921506-S, tax id 995400972, Steuer-ID 04 250 865 749, driving licence ZNCGD336079SP, national ID 0996 0416 2165", ["identity_number"] * 5),
        ("lives at Flat 11, 165 Naslin Avenue, Renhaven.", ["street_address"]),
        ("PO Box 1869, Furbruck 00923; 328B Denmas Blvd\nLinaire 00617; Torrirstraße 396, 00682 Furbruck; 364 rue Virve, 00221 Nusaire; calle Vibol 379, Nusaire", ["street_address"] * 5),
        ("12 main shards and 4 side lanes remain in Kafka", []),
        ("Mira Soquist, Tanholt, Dorya and Dr. Burley met T. Hanley, lilel verholt and TOREL GARHOLT", ["person_name"] * 6),
        ("Mira asked Tonya. Soquist Holdings replied, Field Papers too.", []),
        ("", []),
    ],
)
def test_kinds(text, kinds):
    assert sorted(k for *_, k, _ in pii.spans(text, LEXICON)) == sorted(kinds)


def _identity(text):
    return [text[a:b] for a, b, kind, _ in pii.spans(text, LEXICON) if kind == "identity_number"]


def test_checksums_decide_where_words_do_not():
    twelve = next(f"2345 6789 01{n:02d}" for n in range(100) if pii.confirmed("twelve", f"2345 6789 01{n:02d}"))
    other = twelve[:-1] + str((int(twelve[-1]) + 1) % 10)
    assert pii.confirmed("twelve", twelve) and not pii.confirmed("twelve", other)
    # Directly behind the word that names it either counts; further off only the one that passes.
    assert _identity(f"aadhaar {twelve}") == [twelve] and _identity(f"aadhaar {other}") == [other]
    assert _identity(f"as on the aadhaar of the tenant we read {twelve}") == [twelve] and _identity(f"as on the aadhaar of the tenant we read {other}") == []
    assert _identity(f"the counter shows {twelve}") == []
    # A long specific form that passes mod 97 needs no word; one that fails needs it.
    body = "1 85 05 78 006 084"
    key = 97 - int(body.replace(" ", "")) % 97
    assert _identity(f"filed under {body} {key:02d} since May") == [f"{body} {key:02d}"]
    assert _identity(f"filed under {body} {(key + 1) % 97:02d} since May") == []
    belgian = "85.07.30-033"
    good = f"{belgian}.{97 - 850730033 % 97:02d}"
    assert _identity(f"holder {good}") == [good] and _identity(f"holder {belgian}.{(97 - 850730033 % 97) % 96 + 1:02d}") == []
    # Luhn: a word near it is enough for a number that passes.
    good = next(f"046 454 {n}" for n in range(100, 999) if pii.luhn(f"046454{n}"))
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    assert _identity(f"tax number of the second tenant is {good}") == [good] and _identity(f"tax number of the second tenant is {bad}") == []
    # Issued social security numbers need no word; numbers that cannot be issued do, and fillers are none at all.
    assert _identity("holder 123-45-6789") == ["123-45-6789"] and _identity("holder 923-45-6789") == []
    assert _identity("SSN 923-45-6789") == ["923-45-6789"] and _identity("my ssn is 000-00-0000") == []
    # A weak form that fails is refused even behind the word.
    nhs = next(f"943 476 {n}" for n in range(1000, 9999) if pii.confirmed("nhs", f"943 476 {n}"))
    assert _identity(f"NHS number {nhs}") == [nhs] and _identity(f"NHS number {nhs[:-1]}{(int(nhs[-1]) + 1) % 10}") == []


def test_redaction_keeps_the_rest():
    text = "Ask Mira Soquist (m@x.test), now."
    assert pii.redacted(text, LEXICON) == "Ask [PERSON_NAME] ([EMAIL]), now."
    assert pii.redacted(None, LEXICON) is None and pii.redacted("", LEXICON) == ""


def test_long_text_is_read_to_its_end():
    text = "word " * 60_000 + "x@y.test"
    assert [k for *_, k, _ in pii.spans(text, LEXICON)] == ["email"]


def test_checksums():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod97_rest("3214282912345698765432161182") == 1
    assert pii.confirmed("twelve", "2363 0000 0000") == (pii._verhoeff("236300000000") or pii.luhn("236300000000"))
    assert pii._verhoeff("2363") and not pii._verhoeff("2364")
    assert pii.confirmed("dni", "12345678Z") and not pii.confirmed("dni", "12345678A")


def test_find_personal_data(spark):
    parts = spark.createDataFrame([("Soquist", "family"), ("Lenquist", "family"), ("Mira", "given"), (None, "given")], "name_part string, part_kind string")
    rows = spark.createDataFrame([("a", "Mira Soquist and x@y.test, z@y.test", "x"), ("b", None, "x"), ("c", "", "x"), ("d", " ", "x")], "id string, content string, kind string")
    got = [(r["id"], r["kind"], r["item_no"]) for r in pii.find_personal_data(rows, parts).collect()]
    assert sorted(got) == [("a", "email", 1), ("a", "email", 2), ("a", "person_name", 1)]
    assert pii.find_personal_data(rows.limit(0), parts).count() == 0
    assert [r["content"] for r in pii.redact(rows, parts).orderBy("id").collect()] == ["[PERSON_NAME] and [EMAIL], [EMAIL]", None, "", " "]


# --- 2 vectors -----------------------------------------------------------------------------------


def brute(rows, k, least):
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    out = set()
    for i, v in unit.items():
        near = sorted(((-round(float(v @ w), 12), j) for j, w in unit.items() if j != i))[:k]
        out |= {(min(i, j), max(i, j)) for c, j in near if -c >= least}
    return out


def vector_rows(n):
    rng = np.random.default_rng(5)
    rows = {}
    for i in range(n):
        v = rng.normal(size=16)
        rows[f"v{i:04d}"] = v
        if i % 6 == 0:
            rows[f"w{i:04d}"] = v + rng.normal(size=16) * 0.12
        if i % 9 == 0:
            rows[f"x{i:04d}"] = v * 3.0
    return {k: v.astype(np.float32).astype(np.float64) for k, v in rows.items()}


@pytest.mark.parametrize("block_rows", [40_000, 60])
def test_similar_pairs_match_brute_force(spark, block_rows):
    rows = vector_rows(300)
    data = [(k, [float(x) for x in v], "x") for k, v in rows.items()] * 2
    data += [("short", [1.0], "x"), ("zero", [0.0] * 16, "x"), ("nan", [float("nan")] * 16, "x"), ("none", None, "x"), (None, [1.0] * 16, "x"), ("hole", [None] + [1.0] * 15, "x"), ("inf", [float("inf")] + [1.0] * 15, "x")]
    df = spark.createDataFrame(data, "memory_id string, embedding array<float>, rank string")
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 5, 0.9, dim=16, block_rows=block_rows).collect()}
    want = brute(rows, 5, 0.9)
    assert not got - want and len(got) >= 0.97 * len(want)


def test_best_of_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    rows = {f"d{i:03d}": (centre + rng.normal(size=64) * 0.03).astype(np.float32).astype(np.float64) for i in range(400)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "memory_id string, embedding array<float>")
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 5, 0.9).collect()}
    want = brute(rows, 5, 0.9)
    assert not got - want and len(got) >= 0.97 * len(want)


def test_many_copies_stay_linear(spark):
    data = [(f"c{i:03d}", [1.0, 2.0, 3.0, 4.0]) for i in range(120)] + [("q", [-1.0, 0.0, 0.0, 0.0])]
    got = vectors.nearest(spark.createDataFrame(data, "memory_id string, embedding array<float>"), 5, 0.9, dim=4).collect()
    assert len(got) == 600
    assert {r["other"] for r in got if r["id"] == "c050"} == {"c000", "c001", "c002", "c003", "c004"}
    assert {r["other"] for r in got if r["id"] == "c002"} == {"c000", "c001", "c003", "c004", "c005"}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "memory_id string, embedding array<float>")
    assert vectors.similar_pairs(empty).count() == 0


def test_exact_blocks(spark):
    rows = vector_rows(80)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "memory_id string, embedding array<float>")
    got = vectors.nearest_exact(df, df.where("memory_id like 'v00%'"), 3, dim=16, block=30)
    by = {}
    for r in got.collect():
        by.setdefault(r["id"], {})[r["rank"]] = r["other"]
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    for i, near in by.items():
        assert near[1] == min((-round(float(unit[i] @ w), 12), j) for j, w in unit.items() if j != i)[1]


def test_exact_with_repeats_and_copies(spark):
    rows = vector_rows(60)
    data = [(k, [float(x) for x in v]) for k, v in rows.items()]
    data += [(f"c{i:03d}", data[0][1]) for i in range(200)]
    whole = {k: np.array(v) for k, v in data}
    # Repeated next to each other, so that one batch holds each row several times.
    df = spark.createDataFrame([r for r in reversed(data) for _ in range(4)], "memory_id string, embedding array<float>").coalesce(1)
    asked = ["v0000", "v0001", "c150", "w0006"]
    got = vectors.nearest_exact(df, df.where(F.col("memory_id").isin(asked)), 5, dim=16).collect()
    unit = {i: v / np.linalg.norm(v) for i, v in whole.items()}
    for i in asked:
        want = sorted((-round(float(unit[i] @ w), 12), j) for j, w in unit.items() if j != i)[:5]
        assert [r["other"] for r in sorted(got, key=lambda r: r["rank"]) if r["id"] == i] == [j for _, j in want]


def test_every_vector_has_its_nearest(spark):
    rows = vector_rows(120)
    data = [(k, [float(x) for x in v]) for k, v in rows.items()] + [(f"c{i}", [1.0] * 16) for i in range(9)]
    whole = {k: np.array(v) for k, v in data}
    got = vectors.nearest_of_all(spark.createDataFrame(data * 2, "memory_id string, embedding array<float>"), 5, dim=16).collect()
    unit = {i: v / np.linalg.norm(v) for i, v in whole.items()}
    want = {(i, j) for i, v in unit.items() for _, j in sorted((-round(float(v @ w), 12), j) for j, w in unit.items() if j != i)[:5]}
    found = {(r["id"], r["other"]) for r in got}
    assert len(got) == 5 * len(whole) and len(found & want) >= 0.99 * len(want)


def test_query_of_neighbours_leaves_no_vector_out(spark, small):
    from loci.llm.queries import QUERIES

    got = QUERIES["p2_neighbours"](spark, small)
    usable = vectors._one_each(spark.read.parquet(f"{small}/memory_embeddings.parquet"), "memory_id", "embedding", 64)
    assert got.groupBy("memory_id").count().where("count = 5").count() == usable.count() > 0


def test_shape_grows_with_the_collection():
    sizes = [vectors.prefix_length(n) for n in (10**4, 10**6, 10**8, 10**9)]
    assert sizes == sorted(sizes) and vectors.same_bucket(0.98) > vectors.same_bucket(0.9) and abs(vectors.same_bucket(0.0) - 0.49) < 0.02
    # Near copies at a hundred million rows.
    assert vectors.expected_recall(10**8, 0.98) >= 0.93 and vectors.expected_recall(10**5, 0.95) >= 0.98
    plans = vectors.perturbations(8, 12)
    assert plans[0] == (0,) and len(plans) == 12 and all(15 - r not in p for p in plans for r in p)


# --- 3 near duplicates ---------------------------------------------------------------------------


def edited(text):
    words = text.split()
    for _ in range(RNG.randint(0, 3)):
        words[RNG.randrange(len(words))] = RNG.choice(WORDS)
    if RNG.random() < 0.3:
        words = words[len(words) // 2 :] + words[: len(words) // 2]
    return " ".join(words)


def near_rows():
    rows = {}
    for i in range(160):
        base = sentence(40)
        rows[f"a{i:03d}"] = base
        for j in range(RNG.choice([0, 0, 1, 3])):
            rows[f"b{i:03d}{j}"] = edited(base)
    rows |= {f"s{i}": "too short" for i in range(3)} | {f"k{i}": "Copy of " + rows["a000"] for i in range(4)}
    return rows


# In one node; split a level deeper; split into blocks; crowded labels in blocks.
@pytest.mark.parametrize("bounds", [{}, {"node_rows": 30}, {"node_rows": 4}, {"block_rows": 2}])
def test_near_duplicates_match_brute_force(spark, bounds):
    rows = near_rows()
    rows |= {f"h{i:03d}": edited(rows["a001"]) for i in range(60)}  # a crowded place
    sets = {k: set(edge_words(v)) for k, v in rows.items()}
    sets = {k: v for k, v in sets.items() if len(v) >= 20}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    data = [(k, v, "x") for k, v in rows.items()] * 2 + [("null", None, "x"), ("empty", "", "x"), (None, rows["a000"], "x")]
    df = spark.createDataFrame(data, "id string, content string, node string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicate_pairs(df, threshold=0.7, least=20, **bounds).collect()}
    crowd = lambda pair: pair[0][0] == "h" or pair[1][0] == "h"
    assert not got - want and len({p for p in want - got if not crowd(p)}) <= 0.03 * len({p for p in want if not crowd(p)})
    # Records of one place share their fate under few root functions, so their pairs are no independent draws.
    assert len(want - got) <= 0.1 * len(want)
    # The same groups come of the pairs and of the links that span them.
    edges = spark.createDataFrame([(a, b) for a, b in got], "src string, dst string")
    roots = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    groups = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(df, threshold=0.7, least=20, **bounds).collect()}
    apart = [k for k in sets if groups[k] != roots.get(k, k)]
    assert set(groups) == set(sets) and len(apart) <= 0.03 * len(sets)


def test_groups_are_components(spark):
    base = sentence(60).split()
    rows = [("m1", " ".join(base)), ("m2", " ".join(base[:55] + ["zz1", "zz2", "zz3"])), ("m3", " ".join(base[:50] + ["zz1", "zz2", "zz3", "zz4"])), ("m4", " ".join(base)), ("o", sentence(50)), ("short", "two words"), ("same", "Words, two!")]
    got = {r["id"]: r["group_id"] for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id string, content string"), threshold=0.7).collect()}
    assert {got[i] for i in ("m1", "m2", "m3", "m4")} == {"m1"} and got["o"] == "o" and got["short"] == got["same"] == "same"


def test_a_group_of_a_third_is_linear(spark):
    """Links that span a crowded node, not its pairs."""
    base = sentence(40).split()
    words = [" ".join([*base, f"own{i}"]) for i in range(1500)]
    df = spark.createDataFrame([(f"{i:05d}", w) for i, w in enumerate(words)] + [(f"x{i:04d}", sentence(30)) for i in range(3000)], "id string, content string")
    run = neardup.NearDuplicates(df, "id", "content", 0.7, spanning=True)
    assert run.links.count() < 4 * 1500
    assert len({r["group_id"] for r in run.groups().where("id < 'x'").collect()}) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("x", "x")], "src string, dst string")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and got["y"] == "x"


def test_prefixes_follow_the_data_and_meet_the_target():
    # The nodes a record goes to depend on threshold and target alone, so that what moves grows with the records only.
    roots = neardup.roots_needed(0.7, 0.96)
    assert 1 - (1 - 0.7 * neardup.INSIDE) ** roots >= 0.96 and roots == 3
    # Pairs at the threshold meet whether their node is sparse or crowded.
    for others in (5, 400, 6000):
        rng, hit, pairs = np.random.default_rng(others), 0, 60
        words = []
        for n in range(pairs):
            both = rng.integers(0, 2**48, 28)
            words += [np.concatenate([both, rng.integers(0, 2**48, 6)]) for _ in range(2)]  # 28 of 40
        words += [np.concatenate([rng.integers(0, 400, 12), rng.integers(0, 2**48, 20)]) for _ in range(others)]
        packed = [np.sort(w.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for w in words]
        node = neardup.Node(np.zeros(len(words), np.int64), packed, 0.7, False)
        node.match()
        found = set(zip(*(x.tolist() for x in node.pairs()[:2]), strict=True))
        hit = sum((2 * n, 2 * n + 1) in found for n in range(pairs))
        assert hit >= 0.93 * pairs
    assert neardup.shingle_set("a b c d e f") == {"a b c d e", "b c d e f"}


def test_what_moves_at_a_hundred_million_records():
    """Bytes to the nodes by record of 30 words, with a fifth of the rows in nodes a level deeper: under four times the 200 bytes a record has as input."""
    rows = neardup.roots_needed(0.7, 0.96) * (0.8 + 0.2 * neardup.roots_needed(0.7, neardup.INSIDE))
    members = 8 * neardup.roots_needed(0.7, 0.96) + 16 + 20
    assert 0.63 * rows * (30 * 6 + 24 + 4) + members < 4 * 200


def test_vectors_with_the_prefix_of_a_hundred_million_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    rows = [(f"b{i:04d}", v.tolist()) for i, v in enumerate(base)]
    rows += [(f"n{i:04d}", (base[i] + rng.uniform(0.05, 0.25) * rng.normal(size=64)).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "memory_id string, embedding array<float>")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(v @ v.T >= 0.9, 1))
    want = {(rows[a][0], rows[b][0]) for a, b in zip(i, j, strict=True)}
    got = {(r["a"], r["b"]) for r in vectors.similar_pairs(df, as_of=10**8).collect()}
    assert not got - want and len(got & want) >= 0.95 * len(want)


def test_no_records(spark):
    empty = spark.createDataFrame([], "id string, content string")
    assert neardup.near_duplicate_pairs(empty).count() == 0 and neardup.near_duplicate_groups(empty).count() == 0


# --- 4 leximin ------------------------------------------------------------------------------------


def test_leximin(spark):
    rows = [
        (1, "all-round", 50.0, 0.6, 0.8, 0), (1, "peak", 9000.0, None, float("nan"), 0), (1, "low", 10.0, 0.5, 0.1, 0), (1, "low", 10.0, 0.5, 0.1, 0), (1, "neg", -5.0, 0.7, None, 0),
        (2, "b", None, None, None, 0), (2, "a", None, None, None, 0), (None, "z", 1.0, 1.0, 1.0, 0), (3, None, 1.0, 1.0, 1.0, 0),
    ]
    df = spark.createDataFrame(rows, "g bigint, i string, x double, y double, z double, total int")
    first = {r["g"]: r["i"] for r in leximin.leximin_first(df, "g", "i", ["x", "y", "z"]).collect()}
    assert first == {1: "all-round", 2: "a"}
    ranks = {(r["g"], r["i"]): r["rank"] for r in leximin.leximin_ranks(df, "g", "i", ["x", "y", "z"]).collect()}
    assert ranks[(1, "all-round")] == 1 and ranks[(1, "low")] == 2 and ranks[(2, "a")] == ranks[(2, "b")] == 1
    assert leximin.leximin_first(df.limit(0), "g", "i", ["x"]).count() == 0


# --- 6 distinctive terms ---------------------------------------------------------------------------


def test_leximin_in_a_large_group(spark):
    rng = random.Random(3)
    rows = [("hot", f"i{n:04d}", *[None if rng.random() < 0.2 else rng.random() for _ in range(3)]) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, i string, x double, y double, z double")
    got = leximin.leximin_ranks(df, "g", "i", ["x", "y", "z"]).collect()
    keys = sorted((tuple(r["weakest_first"]) for r in got), reverse=True)
    first = {}
    for n, key in enumerate(keys, 1):
        first.setdefault(key, n)
    assert len(got) == 3000 and all(r["rank"] == first[tuple(r["weakest_first"])] for r in got)


def slow_weights(texts, share):
    from collections import Counter

    tf = {i: Counter(edge_words(t)) for i, t in texts.items()}
    cf = sum(tf.values(), Counter())
    total = sum(cf.values())
    out = {}
    for i, c in tf.items():
        n = sum(c.values())
        p = {w: k / n for w, k in c.items()}
        for _ in range(parsimony.ROUNDS):
            e = {w: c[w] * share * p[w] / ((1 - share) * cf[w] / total + share * p[w]) for w in c}
            s = sum(e.values())
            new = {w: x / s for w, x in e.items()}
            done = max(abs(new[w] - p[w]) for w in c) <= parsimony.TOLERANCE
            p = new
            if done:
                break
        out |= {(i, w): p[w] for w in p}
    return out


@pytest.mark.parametrize("bound", [10**6, 0])
def test_term_weights_match_brute_force(spark, bound):
    texts = {f"m{i}": sentence(RNG.randint(1, 40)) + (" Rare, rare RARE!" if i % 25 == 0 else "") for i in range(120)}
    data = [(k, v, "x") for k, v in texts.items()] * 2 + [("n", None, "x"), ("e", " ", "x"), (None, "w", "x")]
    df = spark.createDataFrame(data, "id string, content string, term string")
    got = {(r["id"], r["term"]): r["weight"] for r in parsimony.distinctive_terms(df, broadcast_terms=bound).collect()}
    want = slow_weights(texts, parsimony.RECORD_SHARE)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert got[("m0", "rare")] == max(v for k, v in got.items() if k[0] == "m0")
    few = parsimony.distinctive_terms(df, min_tf=3, min_df=2, max_df=10, broadcast_terms=bound).collect()
    assert all(r["tf"] >= 3 and 2 <= r["df"] <= 10 for r in few) and {r["id"] for r in few if r["term"] == "rare"} == {f"m{i}" for i in range(0, 120, 25)}


def test_no_terms(spark):
    assert parsimony.distinctive_terms(spark.createDataFrame([], "id string, content string")).count() == 0


# --- 7 packing --------------------------------------------------------------------------------------


def test_best_two_fit_is_whole_and_tight():
    sizes = [RNG.randint(1, 200) for _ in range(2000)]
    bins = packing.best_two_fit(sizes, 256)
    assert sorted(itertools.chain(*bins)) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 256 for b in bins)
    assert sum(sizes) / (256 * len(bins)) > 0.98
    # Greedy fills 6 + 3, gap 1; the pair 2 + 2 in place of the 3 fills it.
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in packing.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]
    assert packing.best_two_fit([], 5) == [] and packing.best_two_fit([5, 5], 5) in ([[0], [1]], [[1], [0]])


def test_pack(spark):
    rows = [(i, RNG.randint(1, 60)) for i in range(300)] + [(1000, 250), (1001, 0), (1002, None), (1003, 100)]
    sizes = spark.createDataFrame(rows, "id bigint, n_tokens bigint")
    out = packing.pack(sizes, [(1, 100), (2, 400)], shard_items=64).collect()
    for budget, capacity in ((1, 100), (2, 400)):
        mine = [r for r in out if r["budget_id"] == budget]
        per, whole = {}, {}
        for r in mine:
            per[r["container_id"]] = per.get(r["container_id"], 0) + r["n_tokens"]
            whole[r["id"]] = whole.get(r["id"], 0) + r["n_tokens"]
        assert max(per.values()) <= capacity and whole == {i: n for i, n in rows if n}
        assert {r["id"] for r in mine if r["parts"] > 1} == {i for i, n in rows if n and n > capacity}
    assert packing.pack(sizes.limit(0), [(1, 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sizes, [(1, 0)])


def test_token_counts(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r["id"]: r["n_tokens"] for r in packing.token_counts(rows).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# --- 8 leakage ----------------------------------------------------------------------------------------


def leak_rows():
    tests = {i: sentence(30) for i in range(12)} | {90: "too short", 91: "", 92: sentence(12)}
    docs = {}
    for d in range(120):
        text = sentence(RNG.randint(0, 80))
        if d % 4 == 0:
            w = tests[d % 12].split()
            n = RNG.choice([11, 12, 13, 30])
            a = RNG.randrange(len(w) - n + 1)
            text += " " + ", ".join(w[a : a + n]).upper() + " " + sentence(5)
        docs[d] = text
    docs[200], docs[201] = tests[92], None
    return docs, tests


@pytest.mark.parametrize("block", [10**7, 300])
def test_phrases_match_brute_force(spark, block):
    docs, tests = leak_rows()
    grams = {}
    for i, t in tests.items():
        w = run_words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs.items():
        w = run_words(t)
        for k in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()], "doc_id bigint, text string, item int")
    td = spark.createDataFrame([(i, "passage", t) for i, t in tests.items()] + [(93, "passage", None)], "item bigint, field string, text string")
    found = leakage.phrase_matches(df, td, block_chars=block).collect()
    assert {(r["id"], r["item"]) for r in found} == want and min(r["words"] for r in found) >= 12
    assert leakage.phrase_matches(df.limit(0), td).count() == 0 and leakage.phrase_matches(df, td.limit(0)).count() == 0


def test_proximity_finds_reworded_material(spark):
    words = [f"rare{i}" for i in range(10)]
    test = spark.createDataFrame([(1, "passage", " ".join(w + " the" for w in words))], "item bigint, field string, text string")
    shuffled = words[:]
    RNG.shuffle(shuffled)
    docs = spark.createDataFrame([(1, sentence(50) + " " + " and ".join(shuffled)), (2, (" " + sentence(40) + " ").join(words)), (3, sentence(80))], "doc_id bigint, text string")
    assert [r["id"] for r in leakage.proximity_matches(docs, test).collect()] == [1]


# --- 9 truncation -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,how",
    [
        ("All is well.", "terminal"), ('He said "go."', "terminal"), ("Is it? (see job 44)", "terminal"), ("Done!", "terminal"), (None, "blank"), (" \n", "blank"), ("", "blank"),
        ("The courier went to", "open"), ("One.\n12.", "number"), ("The archive...", "marked"), ("The archi…", "marked"), ("The arch�", "marked"), ("Half of it [truncated]", "marked"),
        ("Fine.\n\n-- Mira", "closing"), ("Fine.\n\nBest,\nMira", "closing"), ("Fine.\n\n#memory #recall", "closing"), ("Run:\n```\nmake\n```", "closing"), ("Run:\n```\nmake", "open"), ("Run:\n```", "open"),
        ("Fine.\n\nhttps://docs.test/x", "closing"), ("Fine.\n\n- [x] done", "closing"), ("EOF", "closing"), ("Fine.\n\n[end of transcript]", "terminal"), ("A.\n\n## Outcome", "open"), ("Bob: said the", "open"),
    ],
)
def test_endings(spark, text, how):
    row = spark.createDataFrame([(text,)], "t string").select(truncation.ending(F.col("t")).alias("e")).first()
    assert row["e"] in ({how, "closing"} if how == "terminal" and text.endswith("]") else {how})


def test_the_spike_decides_for_endings_that_say_little(spark):
    ends = ["\n12.", "\n- Mira", "\nthe", "done."]
    rows = [(i, ("x" * 300)[: 100 - len(ends[i % 4]) - i // 4 % 2] + str(i // 8 % 10) + ends[i % 4], "limited") for i in range(80)]
    rows += [(100 + i, "y" * (50 + 3 * i) + ends[i % 4], "free") for i in range(40)]
    got = {r["doc_id"]: r["truncated"] for r in truncation.assessed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert [got[i] for i in range(4)] == [True, True, True, False] and [got[100 + i] for i in range(4)] == [False, False, True, False]


def test_limits_and_shares(spark):
    rows = []
    for i in range(60):
        rows.append((i, "Fine. " + sentence(RNG.randint(5, 60)) + ".", "free"))
    for i in range(60, 120):
        t = sentence(60)
        rows.append((i, t[:200] if i % 2 else t[:90] + ".", "limited"))
    t = "é" * 10 + sentence(80)
    rows += [(i, t[:10] + sentence(80)[: 300 - 20], "bytes") for i in range(120, 150)] + [(200, None, "limited"), (201, " ", None), (202, "x. #", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("limit", F.lit("x"))
    limits = {(r["source"], r["unit"]): r["limit"] for r in truncation.length_limits(df).collect()}
    assert limits[("limited", "chars")] == 200 and limits[("bytes", "bytes")] == 300 and ("free", "chars") not in limits
    cut = {r["doc_id"] for r in truncation.assessed(df).where("truncated").collect()}
    assert {i for i in range(61, 120, 2)} <= cut and not cut & set(range(60)) and 200 not in cut
    shares = {r["source"]: r["share"] for r in truncation.truncation_shares(df).collect()}
    assert math.isclose(shares["limited"], 0.5) and shares["free"] == 0.0
    assert truncation.assessed(df.limit(0)).count() == 0


