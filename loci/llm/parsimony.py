"""How distinctive a term is for a record: parsimonious language models.

For every record, expectation-maximisation splits its term counts between a record model and the
background of the whole collection; what converges in the record model is specific to the record.
Background counts are of all records. They are broadcast as three number arrays while their count
stays under a stated bound, and joined beyond it, with the same result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.words import Hasher, edge_words
from loci.runtime import stored

#: Weight of the record model in the mixture; the rest is background.
RECORD_SHARE = 0.1
ROUNDS = 50
TOLERANCE = 1e-6
#: Terms of a broadcast background: 24 bytes each, so at most 48 MB a Python worker.
BROADCAST_TERMS = 2_000_000
_FLUSH = 400_000


def converge(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, share: float, rounds: int, tolerance: float) -> np.ndarray:
    """Record-model probabilities of terms laid out record after record; ``starts`` are the records' offsets.

    Each record stops on its own when no probability moves more than ``tolerance``, so a result
    does not depend on the records it is computed with.
    """
    lengths = np.diff(np.append(starts, tf.size))
    p = tf / np.repeat(np.add.reduceat(tf, starts), lengths)
    live = np.ones(tf.size, dtype=bool)
    for _ in range(rounds):
        e = tf * (share * p) / ((1 - share) * background + share * p)
        new = e / np.repeat(np.add.reduceat(e, starts), lengths)
        moved = np.repeat(np.maximum.reduceat(np.abs(new - p), starts), lengths)
        p = np.where(live, new, p)
        live &= moved > tolerance
        if not live.any():
            break
    return p


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, df, cf = Hasher(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(cf)
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([df[k] for k in keys], pa.int64()), pa.array([cf[k] for k in keys], pa.int64())],
            names=["h", "df", "cf"],
        )
        df.clear()
        cf.clear()
        return out

    for batch in batches:
        for text in batch.column(1).to_pylist():
            hashes = [hasher[w] for w in edge_words(text)]
            cf.update(hashes)
            df.update(set(hashes))
        if len(cf) > _FLUSH:
            yield flush()
    yield flush()


def _weigh(
    batches: Iterator[pa.RecordBatch], known, total: int, share: float, rounds: int, tolerance: float, min_tf: int, min_df: int, max_df: int | None
) -> Iterator[pa.RecordBatch]:
    keys, dfs, cfs = known.value
    hasher = Hasher()
    for batch in batches:
        rows, terms, tf, hashes, starts = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            counts = Counter(edge_words(text))
            if counts:
                starts.append(len(tf))
                rows.extend([i] * len(counts))
                terms.extend(counts)
                tf.extend(counts.values())
                hashes.extend([hasher[w] for w in counts])
        if not tf:
            continue
        tf = np.array(tf, dtype=np.int64)
        h = np.array(hashes, dtype=np.int64)
        # A term that is not known is in this record alone: its background is its own count.
        df, cf = np.ones_like(tf), tf.copy()
        if keys.size:
            at = np.minimum(np.searchsorted(keys, h), keys.size - 1)
            hit = keys[at] == h
            df[hit], cf[hit] = dfs[at[hit]], cfs[at[hit]]
        p = converge(tf.astype(np.float64), cf / total, np.array(starts), share, rounds, tolerance)
        keep = (tf >= min_tf) & (df >= min_df)
        if max_df is not None:
            keep &= df <= max_df
        keep = np.flatnonzero(keep)
        if keep.size:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(rows)[keep])),
                    pa.array([terms[k] for k in keep], pa.string()),
                    pa.array(tf[keep]), pa.array(df[keep]), pa.array(p[keep]),
                ],
                names=["id", "term", "tf", "df", "weight"],
            )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        rows, terms, tf = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            counts = Counter(edge_words(text))
            rows.extend([i] * len(counts))
            terms.extend(counts)
            tf.extend(counts.values())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64()),
             pa.array([hasher[w] for w in terms], pa.int64())],
            names=["id", "term", "tf", "h"],
        )


def _weigh_group(table: pa.Table, total: int, share: float, rounds: int, tolerance: float) -> pa.Table:
    rows = table.sort_by("term")
    tf = rows.column("tf").to_numpy().astype(np.float64)
    p = converge(tf, rows.column("cf").to_numpy() / total, np.array([0]), share, rounds, tolerance)
    return pa.table({"id": rows.column("id"), "term": rows.column("term"), "tf": rows.column("tf"), "df": rows.column("df"), "weight": pa.array(p)})


def distinctive_terms(
    records: DataFrame,
    ident: str = "id",
    text: str = "content",
    share: float = RECORD_SHARE,
    min_tf: int = 1,
    min_df: int = 1,
    max_df: int | None = None,
    broadcast_terms: int = BROADCAST_TERMS,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``(ident, term, tf, df, weight)``: the words of each record with their converged weight.

    Weights of a record sum to 1. Rows repeated under one id count once (by their greatest text).
    Null ids, and null, empty and blank texts, have no rows. ``min_tf``, ``min_df`` and ``max_df``
    only choose which rows come out; every word counts in the models. Terms are told apart by
    64-bit hashes in the background counts. Other columns are ignored.
    """
    named = records.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = named.schema["id"].dataType.simpleString()
    # Read twice: once for the background, once for the records. Stored, so that the rows delivered again are dropped once.
    once = stored(named.groupBy("id").agg(F.max("text").alias("text")), "records")
    vocabulary = once.mapInArrow(_vocabulary, "h bigint, df bigint, cf bigint").groupBy("h").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    vocabulary = stored(vocabulary, "vocabulary")
    size = vocabulary.agg(F.sum("cf").alias("total"), F.count(F.when(F.col("df") > 1, 1)).alias("shared"), F.sum("df").alias("pairs")).first()
    total = int(size["total"] or 1)
    out = f"id {kind}, term string, tf bigint, df bigint, weight double"
    if size["shared"] <= broadcast_terms:
        got = vocabulary.where(F.col("df") > 1).toArrow()
        keys = got.column("h").to_numpy()
        order = np.argsort(keys)
        known = records.sparkSession.sparkContext.broadcast((keys[order], got.column("df").to_numpy()[order], got.column("cf").to_numpy()[order]))
        weigh = functools.partial(
            _weigh, known=known, total=total, share=share, rounds=rounds, tolerance=tolerance, min_tf=min_tf, min_df=min_df, max_df=max_df
        )
        result = once.mapInArrow(weigh, out)
    else:
        pairs = once.mapInArrow(_pairs, f"id {kind}, term string, tf bigint, h bigint")
        # At most 10,000 terms can hold a ten-thousandth of all pairs each: these, the skewed ones, are broadcast.
        heavy = F.col("df") * 10_000 >= int(size["pairs"])
        frequent = F.broadcast(vocabulary.where(heavy).select("h", F.col("df").alias("df1"), F.col("cf").alias("cf1")))
        marked = pairs.join(frequent, "h", "left")
        rare = vocabulary.where(~heavy)
        common = marked.where(F.col("df1").isNotNull()).select("id", "term", "tf", F.col("df1").alias("df"), F.col("cf1").alias("cf"))
        joined = marked.where(F.col("df1").isNull()).select("id", "term", "tf", "h").join(rare, "h").select("id", "term", "tf", "df", "cf")
        weigh = functools.partial(_weigh_group, total=total, share=share, rounds=rounds, tolerance=tolerance)
        result = common.unionByName(joined).groupBy("id").applyInArrow(lambda t: weigh(t), out)
        result = result.where((F.col("tf") >= min_tf) & (F.col("df") >= min_df))
        if max_df is not None:
            result = result.where(F.col("df") <= max_df)
    return result.withColumnRenamed("id", ident)
