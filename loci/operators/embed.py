"""Hashed bag-of-words vectors, sparse and dense, as plain DataFrame operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions import text as X

DIM = 384


class Embedder(Protocol):
    """What an external provider offers: vectors for a list of texts, in order."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def token_features(tokens: DataFrame, dim: int = DIM) -> DataFrame:
    """``(token, first, second, sign)``: the two cells and the sign of every different token."""
    one = tokens.select("token").distinct()
    cell = lambda c: F.pmod(X.fnv1a32(c), F.lit(dim))
    odd = F.pmod(X.fnv1a32(F.concat("token", F.lit("_sign"))), F.lit(2))
    return one.select(
        "token", cell(F.col("token")).alias("first"), cell(F.concat("token", F.lit("_salt"))).alias("second"), F.when(odd == 0, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign")
    )


def sparse(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, cell, value)`` of ``texts(id, text)``: L2-normalised, cells that cancel out dropped.

    Each different token adds (1 + ln tf) with its sign at two cells, each adjacent pair of tokens
    0.5 at one. Hashes are worked out once per different token and pair, not per occurrence. Texts
    without tokens have no rows, which is the zero vector.
    """
    words = texts.select("id", X.embedding_tokens(F.col("text")).alias("w"))
    counts = words.select("id", F.explode("w").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    features = token_features(counts, dim)
    weight = (1 + F.log("tf")) * F.col("sign")
    tokens = counts.join(features, "token").select("id", F.explode(F.array("first", "second")).alias("cell"), weight.alias("value"))
    couples = words.where(F.size("w") > 1).select(
        "id", F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws("_", a, b))).alias("pair")
    )
    couples = couples.groupBy("id", "pair").agg(F.count(F.lit(1)).alias("n"))
    cells = couples.select("pair").distinct().select("pair", F.pmod(X.fnv1a32(F.col("pair")), F.lit(dim)).alias("cell"))
    pairs = couples.join(cells, "pair").select("id", "cell", (0.5 * F.col("n")).alias("value"))
    summed = tokens.unionByName(pairs).groupBy("id", "cell").agg(F.sum("value").alias("value")).where(F.abs("value") > 1e-12)
    norms = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return summed.join(norms, "id").select("id", "cell", (F.col("value") / F.col("norm")).alias("value"))


def dense(cells: DataFrame, dim: int = DIM) -> DataFrame:
    """``(id, embedding)`` from sparse rows; a vector's cells are at most ``dim``."""
    packed = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("m"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(dim - 1).cast("bigint"))
    return packed.select("id", F.transform(places, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float")).alias("embedding"))


def sparse_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id, cosine)`` of pairs that share a cell."""
    a, b = left.select(F.col("id").alias("left_id"), "cell", F.col("value").alias("x")), right.select(F.col("id").alias("right_id"), "cell", F.col("value").alias("y"))
    return a.join(b, "cell").groupBy("left_id", "right_id").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def embed_with(texts: DataFrame, make: Callable[[], Embedder], batch: int = 100) -> DataFrame:
    """``(id, embedding)`` by an external provider, in its order, at most ``batch`` texts a call.

    A call that fails is repeated text by text, so one bad text costs only itself (a null vector).
    ``make`` runs once per task.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for rows in batches:
            texts_in, out = rows.column(1).to_pylist(), []
            for k in range(0, len(texts_in), batch):
                part = [t or "" for t in texts_in[k : k + batch]]
                try:
                    out += provider.embed(part)
                except Exception:
                    for t in part:
                        try:
                            out += provider.embed([t])
                        except Exception:
                            out.append(None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")
