"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_saved: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write rows and read them back, which ends their lineage. The folder is spark.checkpoint.dir; only a local session,
    as in tests, gets a temporary one where that is unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='work-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send Python 8 MB at a time, where the session doesn't say otherwise: texts may be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8m")


def discard(spark: SparkSession) -> None:
    """Delete the tables that ``saved`` has made, once what was read from them is done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _saved:
        path = jvm.org.apache.hadoop.fs.Path(_saved.pop())
        path.getFileSystem(conf).delete(path, True)
