"""Session helpers: where durable intermediate results go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_root: str | None = None


def durable_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster each executor would write to its own disk.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _own_root = _own_root or tempfile.mkdtemp(prefix="marketfeat-")
        root = _own_root
    return root.rstrip("/")


def durable_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the durable root."""
    return f"{durable_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage.

    Used before work that reads the same rows many times (model fitting), so a
    lost executor costs a re-read and not a recomputation of the whole chain.
    """
    spark = df.sparkSession
    path = durable_path(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path)
