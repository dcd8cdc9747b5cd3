"""Tables written in the middle of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where none is set, a local session (one machine) gets a folder of its own;
    on a cluster that is an error, since executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slickwake-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written and read again, so that plans that use it twice don't run it twice."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
