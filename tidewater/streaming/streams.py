"""Streaming forms: burst counters, incidents, traces, notifications and usage deltas.

Each takes a streaming (or plain) DataFrame. ``run_once`` drives a stream over what is there and stops, which makes it
testable as a batch. Windows are written once, when the watermark has passed them: then their state goes, and rows that come later are
left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import bursts as B
from tidewater.storage import fresh_path


def stream(spark: SparkSession, df: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the files that the rows are written to."""
    path = fresh_path(spark, "stream")
    df.write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Write a stream's result to the shared folder with an available-now trigger and read it back."""
    spark = df.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", out)
    else:
        writer = df.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    writer.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def minute_slots(counters: DataFrame, late: str = "60 minutes") -> DataFrame:
    """(minute, bucket, access_key, kind, n) in tumbling minutes, closed ``late`` after."""
    window = F.window("ts", "1 minute")
    sums = counters.withWatermark("ts", late).groupBy(window.alias("w"), "bucket", "access_key", "kind").agg(F.sum("n").alias("n"))
    return sums.select(F.col("w.start").alias("minute"), "bucket", "access_key", "kind", "n")


def sliding_bursts(counters: DataFrame, minutes: int = 5, late: str = "60 minutes") -> DataFrame:
    return B.sliding(counters.withWatermark("ts", late), minutes)


def incident_sessions(bursts: DataFrame, late: str = "60 minutes", quiet: str = "15 minutes") -> DataFrame:
    return B.incidents(bursts.withWatermark("ts", late), quiet)


def trace(events: DataFrame, types: list[str] | None = None, at_least: float = 0.0, errors_only: bool = False, is_error: Column | None = None) -> DataFrame:
    """What a subscriber sees: of some types, at least a threshold, perhaps errors alone."""
    out = events.filter(F.col("value") >= at_least)
    if types:
        out = out.filter(F.col("type").isin(types))
    return out.filter(is_error) if errors_only and is_error is not None else out


def listen(events: DataFrame, prefix: str = "", suffix: str = "", names: list[str] | None = None) -> DataFrame:
    out = events.filter(F.col("key").startswith(prefix) & F.col("key").endswith(suffix))
    return out.filter(F.col("event").isin(names)) if names else out


def add_usage(deltas: DataFrame, path: str, batch: int) -> None:
    """One flush of counters (day, bucket, n): appended with its batch number, so that a repeated flush is told by it."""
    deltas.groupBy("day", "bucket").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)


def usage_totals(spark: SparkSession, path: str) -> DataFrame:
    """(day, bucket, n): all flushes added up, a flush that was repeated counting once."""
    once = spark.read.parquet(path).groupBy("day", "bucket", "batch").agg(F.max("n").alias("n"))
    return once.groupBy("day", "bucket").agg(F.sum("n").alias("n"))


def each_batch(df: DataFrame, f: Callable[[DataFrame, int], None], name: str) -> None:
    """Drive a stream through ``f`` batch by batch until nothing is left."""
    state = fresh_path(df.sparkSession, f"{name}-state")
    df.writeStream.foreachBatch(f).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
