"""Reliable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is configured in a local session (tests) a folder of our own is set. On
    a cluster each machine would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="promptwatch-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once and cut its lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def workspace_path(spark: SparkSession) -> str:
    """A new table location in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/promptwatch-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Unlike :func:`checkpoint` the result is columnar, so every reader prunes columns.
    """
    spark = df.sparkSession
    path = workspace_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
