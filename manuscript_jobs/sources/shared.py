"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, under a folder of our own on a single machine,
    and an error on a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = sc._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else _OWN.get(sc.applicationId)
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="manuscript-jobs-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads again: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    system, found = _file(spark, path)
    return system.exists(found)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    system, found = _file(spark, path)
    system.delete(found, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    system, found = _file(spark, path)
    return system.getContentSummary(found).getLength() if system.exists(found) else 0
