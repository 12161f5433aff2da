"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own where it isn't set and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set, and a cluster has no folder that all executors share without it")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage is cut."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
