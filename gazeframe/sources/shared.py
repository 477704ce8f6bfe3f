"""Folders that the driver and all executors share, for tables that are written once and read often."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new name below the folder that ``spark.checkpoint.dir`` names; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    out = shared_folder(df.sparkSession, tag)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)
