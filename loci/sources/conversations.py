"""Conversation benchmarks in JSON: sessions of turns, questions with evidence; and corpora from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loci.functions import lists as L
from loci.functions import text as X

_TURN = "array<struct<speaker string, dia_id string, text string>>"
_QA = "array<struct<question string, answer string, evidence array<string>, category int, adversarial_answer string>>"


def session_time(text: Column) -> Column:
    """Timestamp of '1:56 pm on 8 May, 2023'; months by their first three letters, null if it is none."""
    p = r"^\s*(\d{1,2}):(\d{2})\s*([aApP])[mM]\s+on\s+(\d{1,2})\s+([A-Za-z]{3})[a-z]*,?\s+(\d{4})\s*$"
    part = lambda i: F.regexp_extract(text, p, i)
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    hour = part(1).cast("int") % 12 + F.when(F.lower(part(3)) == "p", 12).otherwise(0)
    month = F.array_position(months, F.lower(part(5)))
    stamp = F.try_make_timestamp(part(6).cast("int"), month.cast("int"), part(4).cast("int"), hour, part(2).cast("int"), F.lit(0).cast("decimal(8,6)"))
    return F.when(part(1) != "", stamp)


def canonical_time(stamp: Column) -> Column:
    """The same text form for every spelling of a time."""
    return F.concat(F.lower(F.date_format(stamp, "h:mm a")), F.lit(" on "), F.date_format(stamp, "d MMMM, yyyy"))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a JSON array of ``{sample_id, conversation, qa}``.

    Sessions are counted from 1 up to the first gap; those without a readable time are left out.
    An unknown category is an error when its question is read.
    """
    schema = T.StructType.fromDDL(f"sample_id string, conversation map<string, string>, qa {_QA}")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    numbered = F.filter(
        F.transform(F.map_keys("conversation"), lambda k: F.regexp_extract(k, r"^session_(\d+)$", 1).try_cast("int")), lambda n: n.isNotNull()
    )
    ordered = F.sort_array(numbered)
    unbroken = F.filter(F.transform(ordered, lambda n, i: F.when(n == i + 1, n)), lambda n: n.isNotNull())
    per = raw.select("sample_id", "conversation", F.explode(unbroken).alias("session"))
    key = F.concat(F.lit("session_"), F.col("session").cast("string"))
    per = per.select(
        "sample_id", "session", session_time(F.col("conversation")[F.concat(key, F.lit("_date_time"))]).alias("date"), F.from_json(F.col("conversation")[key], _TURN).alias("turns")
    )
    turns = per.where("date is not null").select("sample_id", "session", "date", F.explode("turns").alias("t"))
    turns = turns.select(
        F.col("sample_id").alias("conversation"), "session", "t.dia_id", "date", "t.speaker", "t.text",
        X.rendered_turn(canonical_time(F.col("date")), F.col("t.speaker"), F.col("t.text")).alias("content"),
    )
    names = F.create_map(*[F.lit(v) for pair in L.QUESTION_CATEGORIES.items() for v in pair])
    category = F.coalesce(names[F.col("q.category")], F.raise_error(F.concat(F.lit("unknown category "), F.col("q.category").cast("string"))).cast("string"))
    questions = raw.select("sample_id", F.posexplode("qa").alias("i", "q")).select(
        F.concat("sample_id", F.lit("-q"), F.col("i").cast("string")).alias("id"), F.col("sample_id").alias("conversation"), category.alias("category"), "q.question", "q.answer",
        "q.adversarial_answer", X.evidence_keys(F.array_join("q.evidence", " ")).alias("evidence"),
    )
    return turns, questions


def load_pinned(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """The questions named in a JSON array of ids; an id that is not there is an error."""
    ids = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id")).distinct()
    missing = [r["id"] for r in ids.join(questions, "id", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError("unknown question ids: " + ", ".join(missing))
    return questions.join(ids, "id", "left_semi")


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5, SHA-1) as a Column."""
    space = uuid.UUID(namespace).hex
    made = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(made, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_URL, "loci:turns"))


def turns_corpus(turns: DataFrame, base: str = "2026-08-30 10:00:00") -> DataFrame:
    """One document per turn: ``(id, conversation, content, type, tags, created_at, sources)``; time runs from ``base`` by minutes of the session."""
    key = X.turn_key(F.col("conversation"), F.col("dia_id"))
    return turns.select(
        uuid5(NAMESPACE, key).alias("id"), "conversation", "content", F.lit("episodic").alias("type"), F.array().cast("array<string>").alias("tags"),
        (F.lit(base).cast("timestamp") + F.make_dt_interval(mins=F.col("session"))).alias("created_at"), F.array(key).alias("sources"),
    )


def extracted_corpus(snapshot: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of a snapshot with the turns they come from: ``labels`` is ``(memory_id, dia_ids)``."""
    keyed = labels.select(F.col("memory_id").alias("id"), F.col("dia_ids").alias("__dia"))
    joined = snapshot.join(keyed, "id", "left")
    sources = F.transform(F.coalesce("__dia", F.array().cast("array<string>")), lambda d: F.concat_ws("/", F.col("conversation"), d))
    return joined.withColumn("sources", sources).drop("__dia")
