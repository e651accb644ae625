"""An extension: documents as a stream. New files are read as they come; copies within the watermark are dropped, and
what passes is appended. Exactly once, by the checkpoint in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.cleaning import folded


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def without_copies(stream: DataFrame, text: str = "content", time: str = "arrived", watermark: str = "1 day") -> DataFrame:
    """One row of each folded text within the watermark; the state holds digests and not texts."""
    keyed = stream.withColumn("__key", F.sha2(folded(text), 256)).withWatermark(time, watermark)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def counts_by_window(stream: DataFrame, time: str, every: str, *by: str, watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, watermark).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
