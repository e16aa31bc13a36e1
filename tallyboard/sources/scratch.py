"""A folder that driver and executors share, for what a run writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in plain local mode without that setting a temporary folder of this machine."""
    global _local
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    _local = _local or tempfile.mkdtemp(prefix="tallyboard-")
    return _local


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet into a new shared folder and read back."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
