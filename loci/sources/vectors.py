"""Vector fixtures: records of (SHA-256 of a text, float32 vector) in a packed binary file, or parquet."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout: magic, width and count as little-endian uint32, then records sorted by key. Fixed values.
MAGIC, WIDEST = b"KEMB", 16_000


def write_fixture(rows: dict[bytes, list[float]], path: str) -> None:
    """Write a fixture in place of an old one at once: under another name first, then renamed."""
    widths = {len(v) for v in rows.values()}
    if len(widths) != 1 or not 1 <= (dim := widths.pop()) <= WIDEST:
        raise ValueError(f"vectors must have one width in 1..{WIDEST}")
    temporary = f"{path}.part"
    with open(temporary, "wb") as f:
        f.write(MAGIC + struct.pack("<II", dim, len(rows)))
        for key in sorted(rows):
            f.write(key + np.asarray(rows[key], dtype="<f4").tobytes())
    os.replace(temporary, path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if raw[:4] != MAGIC or len(raw) < 12:
                raise ValueError("no vector fixture")
            dim, n = struct.unpack_from("<II", raw, 4)
            if not 1 <= dim <= WIDEST or len(raw) != 12 + n * (32 + 4 * dim):
                raise ValueError("vector fixture of a wrong size")
            rows = np.frombuffer(raw, dtype=np.dtype([("key", "S32"), ("v", "<f4", (dim,))]), count=n, offset=12)
            keys = [raw[12 + i * (32 + 4 * dim) :][:32] for i in range(n)]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(rows["v"].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), vectors], names=["text_sha", "embedding"])


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """``(text_sha, embedding)`` of all fixture files under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, "text_sha binary, embedding array<float>")


def looked_up(texts: DataFrame, fixture: DataFrame) -> DataFrame:
    """Texts with the vector of exactly this text, null where the fixture has none."""
    key = F.unhex(F.sha2("text", 256))
    return texts.withColumn("text_sha", key).join(fixture, "text_sha", "left").drop("text_sha")


def misses(texts: DataFrame, fixture: DataFrame) -> int:
    """Texts the fixture does not have; a run with misses is void."""
    return texts.withColumn("text_sha", F.unhex(F.sha2("text", 256))).join(fixture, "text_sha", "left_anti").count()
