"""Streams of points over a static raster: a stream-static join on the tile key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geo import GeoTransform, Level
from tessera.operators.sample import sample_band


def read_points(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Points from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sampled(points: DataFrame, tiles: DataFrame, level: Level, transform: GeoTransform, band: int = 0) -> DataFrame:
    """The stream with value: one band at each point."""
    return sample_band(points, tiles, level, transform, band)


def windowed(samples: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, least and greatest value of each window of event time; rows later than `late` are dropped."""
    ok = samples.where(F.col("value").isNotNull() & ~F.isnan("value")).withWatermark(time, late)
    v = F.col("value").cast("double")
    return ok.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most")).select(F.col("window.start").alias("start"), "n", "mean", "least", "most")


def drain_files(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All rows that the stream has now, appended as Parquet to a new folder below `folder` and read from there.

    folder: of a store that driver and executors share; spark.checkpoint.dir if it is not given, a temporary one only where that is unset too.
    """
    spark = stream.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    where = f"{folder.rstrip('/')}/{uuid.uuid4()}"
    q = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All rows that the stream has now, through a memory table; for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.table(name)
