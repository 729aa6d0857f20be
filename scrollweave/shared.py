"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process.

    On a cluster that names none there is no folder that all can see, and this
    is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="scrollweave-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the JVM ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: its plan ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over several tasks a core, for work that costs far more than its bytes say.

    A number that is given stays, where few bytes would be put into few tasks.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism * 8, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`written` made and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        target, system = _path(df.sparkSession, file)
        system.delete(target.getParent(), True)
