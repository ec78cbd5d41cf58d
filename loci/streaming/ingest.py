"""Structured Streaming around the batch operators: ingest in micro-batches, counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loci.engine import Engine


def ingest_stream(memories: DataFrame, engine: Engine, checkpoint: str, fold: bool = True) -> StreamingQuery:
    """Store every micro-batch of ``memories(content, type, project_id, tags)``; one writer at a time, so later rows see earlier ones."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.store(batch, fold)

    return memories.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``(window_start, key, n)`` by event time; rows later than ``late`` behind the newest are left out when it is a stream."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")


def read_once_per_id(events: DataFrame, ident: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([ident])
