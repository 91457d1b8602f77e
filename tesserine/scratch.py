"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it. Where that is unset a local one, but only if driver and executors are one process: on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = getattr(spark.sparkContext, "_tesserine_folder", None) or "file://" + tempfile.mkdtemp(prefix="tesserine-")
        spark.sparkContext._tesserine_folder = named
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/tesserine/{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_tesserine_paths", []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back. A lost executor costs no rework."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, as after ``stored``; else they stay until the driver happens to collect its garbage.

    A thread of Py4J tells the JVM once a second what Python has let go, and the listeners' queue holds plans until it has been worked off: both come first.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(1.2)
        with contextlib.suppress(Py4JJavaError):  # a queue that takes longer costs disk, not results
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete this session's intermediate tables, once nothing that reads them is needed any more."""
    context = spark.sparkContext
    for path in context.__dict__.pop("_tesserine_paths", []):
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
