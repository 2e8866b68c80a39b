"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set and the master is local, as in tests, a temporary one takes its place."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        sc.setCheckpointDir(there)
    return there.rstrip("/")


def as_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: what it holds is settled, and a lost executor costs none of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
