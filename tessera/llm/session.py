"""Cutting lineage where all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset: a temporary one of this machine if Spark runs on this machine alone, else an error."""
    where = spark.sparkContext._jsc.sc().getCheckpointDir()
    if where.isDefined():
        return where.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> str:
    """The path of df as Parquet in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what `written` wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    return df.sparkSession.read.parquet(written(df))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder that spark.checkpoint.dir names (see shared_folder where it is unset)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
