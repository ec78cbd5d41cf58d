"""Tables under one folder, as a base and deltas, with one commit file for all of them.

A write adds a folder of changed rows (``v=<commit>-<id>/bucket=<n>/``) to the tables it touches and
then creates the next commit file, which names the folders of every table. A commit file is created
under a new name and only if that is free: readers see all of a change or nothing of it, and of two
writers that started from one commit the second fails with ``Conflict`` and starts again. Rows lie in
buckets of their project, so a write reads and writes the buckets of its projects only.
``Store.replace`` folds the deltas into a new base.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loci import schema

#: What a row is known by; the newest delta of a key counts.
KEYS = {
    "memories": ["id"], "embeddings": ["memory_id"], "edges": ["from_id", "to_id", "relationship"], "entities": ["normalized_name", "project_id"],
    "mentions": ["memory_id", "normalized_name", "project_id"], "sessions": ["id"], "access_log": [],
}
#: The column whose hash is the bucket.
PLACE = {"memories": "project_id", "embeddings": "project_id", "entities": "project_id", "mentions": "project_id", "edges": "from_id", "sessions": "id", "access_log": "memory_id"}
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Snapshot:
    number: int
    folders: dict[str, list[str]]


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def init(self) -> Store:
        """Create the first commit if there is none."""
        if self.snapshot().number == 0:
            try:
                self._create(1, {name: [] for name in schema.TABLES})
            except Conflict:
                pass
        return self

    def _create(self, number: int, folders: dict[str, list[str]]) -> None:
        fs, target = self._fs(f"{self.path}/_commits/{number:010d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            if fs.exists(target):
                raise Conflict(f"commit {number} is taken") from e
            raise
        out.write(bytearray(json.dumps({"tables": folders, "whole": True}).encode()))
        out.close()

    def snapshot(self) -> Snapshot:
        """The newest complete commit; 0 without any."""
        fs, folder = self._fs(f"{self.path}/_commits")
        names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in names:
            if not name.endswith(".json"):
                continue
            text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/_commits/{name}").collect())
            try:
                return Snapshot(int(name.split(".")[0]), json.loads(text)["tables"])
            except (ValueError, KeyError):
                continue  # still being written
        return Snapshot(0, {name: [] for name in schema.TABLES})

    @staticmethod
    def bucket(name: str, column: str | None = None):
        return F.pmod(F.xxhash64(F.coalesce(F.col(column or PLACE[name]), F.lit(""))), F.lit(BUCKETS)).cast("int")

    def buckets(self, projects: DataFrame) -> list[int]:
        """The buckets of ``projects(project_id)``: at most ``BUCKETS`` numbers."""
        return [r[0] for r in projects.select(self.bucket("memories", "project_id").alias("b")).distinct().collect()]

    def _raw(self, name: str, folders: list[str], buckets: list[int] | None) -> DataFrame:
        kind = schema.TABLES[name]
        full = T.StructType([*kind.fields, T.StructField("__gone", T.BooleanType()), T.StructField("v", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/{f}" for f in folders])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read(self, name: str, at: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table: the base without the keys of the deltas, and the newest of each key in the deltas."""
        folders = (at or self.snapshot()).folders[name]
        columns, keys = schema.TABLES[name].names, KEYS[name]
        if not keys or len(folders) <= 1:
            return self._raw(name, folders, buckets).where("not coalesce(__gone, false)").select(*columns)
        rest = [c for c in columns if c not in keys]
        deltas = self._raw(name, folders[1:], buckets).groupBy(*keys).agg(F.max_by(F.struct(*rest, "__gone"), "v").alias("r")).select(*keys, "r.*")
        base = self._raw(name, folders[:1], buckets).join(deltas.select(*keys), keys, "left_anti").where("not coalesce(__gone, false)").select(*columns)
        return base.unionByName(deltas.where("not coalesce(__gone, false)").select(*columns))

    def tables(self, at: Snapshot | None = None, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        at = at or self.snapshot()
        return {name: self.read(name, at, buckets if PLACE[name] == "project_id" else None) for name in schema.TABLES}

    def _write(self, name: str, number: int, rows: DataFrame, removed: DataFrame | None) -> str | None:
        """Write changed rows, and keys that are no more; the name of the folder, or null if there are none."""
        all_ = schema.validate_schema(rows, schema.TABLES[name]).withColumn("__gone", F.lit(False))
        if removed is not None:
            gone = removed.select(*[F.col(f.name) if f.name in removed.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.TABLES[name]])
            all_ = all_.unionByName(gone.withColumn("__gone", F.lit(True)))
        folder = f"v={number:010d}-{uuid.uuid4().hex}"
        path = f"{self.path}/{name}/{folder}"
        all_.withColumn("bucket", self.bucket(name)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        fs, target = self._fs(path)
        return folder if any(s.isDirectory() for s in fs.listStatus(target)) else None

    def change(self, at: Snapshot, rows: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> None:
        """Commit changed rows and removed keys on top of the snapshot they were worked out from."""
        removed, folders = removed or {}, dict(at.folders)
        for name in {*rows, *removed}:
            made = self._write(name, at.number + 1, rows.get(name, self.spark.createDataFrame([], schema.TABLES[name])), removed.get(name))
            if made:
                folders[name] = [*folders[name], made]
        self._create(at.number + 1, folders)

    def replace(self, at: Snapshot, tables: dict[str, DataFrame]) -> None:
        """Commit new bases of tables in place of all their folders."""
        folders = dict(at.folders)
        for name, rows in tables.items():
            made = self._write(name, at.number + 1, rows, None)
            folders[name] = [made] if made else []
        self._create(at.number + 1, folders)

    def write(self, name: str, df: DataFrame) -> None:
        self.replace(self.snapshot(), {name: df})

    def append(self, name: str, df: DataFrame) -> None:
        self.change(self.snapshot(), {name: df})

    def ping(self) -> bool:
        return self.spark.range(1).count() == 1
