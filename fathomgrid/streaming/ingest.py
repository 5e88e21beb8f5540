"""Streams: windows over events, the newest version of each key, and changed files into the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.operators.changes import latest
from fathomgrid.plans.durable import run_dir


def read(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A table of a folder as a stream of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "true").parquet(folder)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; events later than `late` are dropped by the watermark."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = at.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and read its result from the shared folder; each batch replaces the one before (complete) or is kept beside it (append), under its own number, so that a repeated batch changes nothing."""
    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def sessions(events: DataFrame, gap_minutes: int = 30, late: str = "1 day") -> DataFrame:
    """(user_id, n, first, last) of each session of a user, which ends with a gap of gap_minutes or more.

    Late events join, or link, the sessions that they belong to. In append
    mode a session is given out once the watermark has passed its end, and
    its state is dropped then; in complete mode all are given out.
    """
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    grouped = rows.groupBy(F.session_window("ts", f"{gap_minutes} minutes"), "user_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return grouped.select("user_id", "n", "first", "last")


def keep_newest(changes: DataFrame, path: str, key: list[str], order: list[str]):
    """A query that keeps the newest version of each key: each batch appends its own newest rows under its number, so that a repeated batch changes nothing and nothing written before is read or rewritten."""

    def add(df: DataFrame, number: int) -> None:
        latest(df, key, order, [c for c in df.columns if c not in key]).select(df.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(add)


def newest(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The newest version of each key over all batches, by one aggregation."""
    rows = spark.read.parquet(path).drop("batch")
    return latest(rows, key, order, [c for c in rows.columns if c not in key]).select(rows.columns)


def compact(spark: SparkSession, path: str, key: list[str], order: list[str]) -> None:
    """Replace the batches that are there by one with the newest versions. Batches added meanwhile stay; a crash between leaves rows twice, of which newest() takes one. To be run while no batch is being repeated."""
    from pyspark.sql.utils import AnalysisException

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("batch=")]
    try:
        rows = spark.read.parquet(*[str(p) for p in old])
    except AnalysisException:
        return
    merged = f"{path}/batch=-{uuid.uuid4().int % 10**12}"
    latest(rows, key, order, [c for c in rows.columns if c not in key]).select(rows.columns).write.parquet(merged)
    for p in old:
        fs.delete(p, True)
