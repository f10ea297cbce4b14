"""A directory of frame bodies as a data source, batch and streaming: stream_id=<id>/<frame_no>.frame.

Reading goes through Spark's own binary file source, so any file system that Spark reads will do. stream_id is a partition
column where a batch is read, so that a filter on it leaves directories out. Packets are written as a Parquet table by stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _packets(files: DataFrame) -> DataFrame:
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    return files.select(
        (F.col("stream_id").cast("string") if "stream_id" in files.columns else part(r"stream_id=([^/]*)/")).alias("stream_id"), part(r"/(\d+)\.frame$").cast("bigint").alias("frame_no"), F.lit(None).cast("bigint").alias("pts"), F.col("content").alias("chunk")
    )


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(stream_id, frame_no, pts, chunk) of all frame bodies in a folder."""
    return _packets(spark.read.format("binaryFile").option("pathGlobFilter", "*.frame").load(folder))


def stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _packets(spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.frame").load(folder))


def write_packets(packets: DataFrame, folder: str) -> None:
    """Packets as a Parquet table, a directory for each stream."""
    packets.write.partitionBy("stream_id").mode("overwrite").parquet(folder)


def packets_table(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    out = spark.read.parquet(folder)
    return out if where is None else out.where(where)
