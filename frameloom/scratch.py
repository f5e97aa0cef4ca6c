"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset and the master is this machine (tests), a folder that goes with the process."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(context, "_frameloom_own_folder", None)
    if own is None:
        path = tempfile.mkdtemp(prefix="frameloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = context._frameloom_own_folder = f"file://{path}"
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/frameloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files, wherever Spark reads it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, whatever executors are lost after it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """The intermediate tables of one computation, which go together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Deletes the tables; what was read from them must have been written by then."""
        while self.paths:
            delete(self.spark, self.paths.pop())
