"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a table of known small size is broadcast; beyond it Spark's own join is left to decide.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session of one process (master ``local``, as in tests) may leave it unset."""
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read, so that what led to it is computed once and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` staged, and marked for broadcast where it has at most ``most`` rows."""
    from pyspark.sql import functions as F

    own = stage(df, "small")
    return F.broadcast(own) if own.count() <= most else own
