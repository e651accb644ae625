"""Sources and sinks of samples and benchmark results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.sampling import META


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """results.json of each model's folder, JSON lines or one array, with the model's name from the path."""
    return spark.read.json(f"{folder}/*/results.json", multiLine=True).withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/results\.json$", 1))


def write_samples(samples: DataFrame, path: str) -> None:
    """JSON lines."""
    samples.write.mode("overwrite").json(path)


def write_dataset(samples: DataFrame, path: str) -> None:
    """Parquet by split, meta as JSON text."""
    split = F.when(F.col("meta.is_test"), "test").otherwise("train")
    samples.withColumn("split", split).withColumn("meta", F.to_json("meta")).write.mode("overwrite").partitionBy("split").parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The samples of a split, meta parsed; a null meta is an empty one."""
    df = spark.read.parquet(path)
    df = df if split is None else df.where(F.col("split") == split)
    return df.withColumn("meta", F.from_json(F.coalesce("meta", F.lit("{}")), META))


def safe_json(value: Any) -> str:
    """JSON with a mark in place of what can't be told."""
    return json.dumps(value, default=lambda x: f"<{type(x).__name__}>", indent=2)
