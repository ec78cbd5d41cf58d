"""Table schemas and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from 'name type, ...'; unlike the built-in parser it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


MEMORIES = struct(
    "id string, content string, type string, project_id string, tags array<string>, created_at timestamp, access_count bigint, decay_score double, content_hash string"
)
EDGES = struct("id string, from_id string, to_id string, relationship string, weight double, created_at timestamp")
ENTITIES = struct("id string, name string, normalized_name string, project_id string")
MENTIONS = struct("memory_id string, normalized_name string, project_id string, weight double, created_at timestamp")
EMBEDDINGS = struct("memory_id string, project_id string, embedding array<float>, created_at timestamp")
SESSIONS = struct("id string, project_id string, agent_id string, started_at timestamp, ended_at timestamp")
ACCESS_LOG = struct("memory_id string, at timestamp")
TURNS = struct("conversation string, session int, dia_id string, date timestamp, speaker string, text string, content string")
QUESTIONS = struct("id string, conversation string, category string, question string, answer string, adversarial_answer string, evidence array<string>")

TABLES = {
    "memories": MEMORIES, "edges": EDGES, "entities": ENTITIES, "mentions": MENTIONS, "embeddings": EMBEDDINGS, "sessions": SESSIONS, "access_log": ACCESS_LOG,
}


def validate_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """``df`` with the expected columns in order; all missing columns and wrong types are named in one error."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: missing" for f in expected if f.name not in have]
    wrong += [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in expected if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise ValueError("schema: " + "; ".join(wrong))
    return df.select(*expected.names)


def dimension(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``(dim, n)``: how many vectors have each length; null vectors have a null length."""
    return df.groupBy(F.when(F.col(column).isNotNull(), F.size(column)).cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def check_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """``df``; a vector of another length fails the query that reads it."""
    bad = F.raise_error(F.concat(F.lit(f"embedding width is not {dim}: "), F.size(column).cast("string")))
    return df.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(bad.cast(df.schema[column].dataType)))
