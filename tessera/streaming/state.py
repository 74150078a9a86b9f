"""Keyed state from a stream, an extension: the batch rules on micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc()))).where("_r = 1").drop("_r")


def upsert_into(path: str, key: str, time: str, tie: str):
    """A foreachBatch function that keeps the last row of each key in versions of a table.

    Every batch writes a new version and then names it, so a batch that is run again gives the same state.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_state(spark, path, before=number)
        rows = batch if old is None else old.unionByName(batch)
        latest(rows, key, time, tie).write.mode("overwrite").parquet(f"{path}/version={number:012d}")

    return run


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version, or None."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = sorted(n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")) and (before is None or int(n[8:]) < before))
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def windowed_counts(stream: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind with a watermark, on a stream or a table."""
    source = stream.withWatermark(time, late) if stream.isStreaming else stream
    return source.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def checkpoint_of(folder: str) -> str:
    return f"{folder}/stream-{uuid.uuid4().hex}"
