"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ENDING: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else the one set on the context; where both are unset, a local session gets a temporary one and a cluster's is refused, since its executors share no folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomgrid-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, deleted when the process ends (and safe to delete once the application is gone)."""
    path = f"{shared_dir(spark)}/fathomgrid-{spark.sparkContext.applicationId}"
    if path not in _ENDING:
        _ENDING.add(path)
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended before
        return


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back.

    The lineage ends at replicated, shared files, so that the loss of an
    executor costs only the tasks that ran on it. Unlike checkpoint(), the
    copy is columnar and compressed, and later steps read only the columns
    that they use.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialized table; df can't be used afterwards."""
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
