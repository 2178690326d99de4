"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: a lost executor costs a re-read, not a recomputation of
everything before it.  The folder is the one named in ``spark.checkpoint.dir``; only for a
local master (tests, a laptop) a temporary one is chosen where that is unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; ValueError on a cluster that names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plexivec-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _in_store(spark: SparkSession, path: str):
    """The path and its file system, as the JVM has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/plexivec/{name}-{uuid.uuid4().hex}"
    where, store = _in_store(spark, path)
    store.deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table that ``staged`` returned and that a later one has replaced; others are left alone."""
    if path := getattr(df, "_staged_at", None):
        where, store = _in_store(df.sparkSession, path)
        store.delete(where, True)
