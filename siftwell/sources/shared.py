"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where they go on a single machine that names no folder.
LOCAL = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one only a local master can go on: other machines would not see the files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return LOCAL


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: its lineage ends there."""
    path = f"{folder(df.sparkSession)}/siftwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
