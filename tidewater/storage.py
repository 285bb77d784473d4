"""The cluster's shared folder, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine, a
    temporary folder is made and set as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_by = spark.sparkContext.getCheckpointDir()
    if set_by is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        set_by = spark.sparkContext.getCheckpointDir()
    return set_by.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/tidewater/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast if they have been counted to be at most ``most``; else a join deals them. Give rows that are cheap to read twice."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
