"""Session, table access and shared-folder helpers used by every operator."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python workers get the functions of this package by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["loci"])


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per context, so that they need no installed copy."""
    sc = spark.sparkContext
    if not getattr(sc, "_loci_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="loci-"), "loci.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        sc._loci_shipped = True
    return spark


def build_session(app: str = "loci", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Call sites of every Column cost two more round trips each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    return ship(spark)


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Scan one parquet table, with only the named columns."""
    ship(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint directory is there (local runs, tests), a
    temporary folder is set; a cluster always names its own.
    """
    ship(spark)
    sc = spark.sparkContext
    named = sc._conf.get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if not current.isDefined():
            sc.setCheckpointDir(named)
        return named
    if not current.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loci-")
        sc.setCheckpointDir(folder)
        return folder
    return current.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}.parquet")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session, as a number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
