"""Benchmark results: predictions joined to samples, errors and differences, rates, pivots and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.udfs import assess

ERRORS = ("request", "json", "schema", "content")
MEANS = ("diff_lines", "chars_added", "chars_missing", "similarity", "inference_ms")


def joined(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions with their samples; those without one are left out."""
    return predictions.join(samples, "sample_id")


def scored(results: DataFrame) -> DataFrame:
    """Results (completion, schema, correct_answer, request_error, synthetic_type) with error_type, correct and the
    differences; the Python pass runs once."""
    told = assess("completion", "schema", "correct_answer", "request_error", "synthetic_type")
    return results.withColumn("__a", told).select(*results.columns, "__a.*")


def rate(hit: Column, digits: int = 3) -> Column:
    return F.round(100.0 * F.count_if(hit) / F.count("*"), digits)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Rates of each error in percent, of correct answers, and means without nulls, by model or over all."""
    have = [c for c in MEANS if c in results.columns]
    cols = [rate(F.col("error_type") == e).alias(f"{e}_errors") for e in ERRORS] + [rate(F.coalesce("correct", F.lit(False))).alias("correct_rate"), F.count("*").alias("n")]
    cols += [F.round(F.avg(c), 3).alias(f"mean_{c}") for c in have]
    return results.groupBy(*by).agg(*cols)


def metric_pivot(long: DataFrame, models: str = "model", metric: str = "metric", value: str = "value", metrics: list[str] | None = None) -> DataFrame:
    return long.groupBy(models).pivot(metric, metrics).agg(F.first(value))


def length_buckets(results: DataFrame, length: str, error: Column, *by: str, width: int = 500) -> DataFrame:
    """Samples, errors and error rate by buckets of a length. Buckets are open at the left, closed at the right; what
    lies beyond the last whole bucket is left out, as is length 0."""
    top = results.agg((F.floor(F.max(length) / width) * width).alias("__top"))  # one row
    rows = results.join(F.broadcast(top), F.lit(True)).where((F.col(length) > 0) & (F.col(length) <= F.col("__top")))
    bucket = (F.ceil(F.col(length) / width) * width).cast("long").alias("bucket")
    return rows.groupBy(*by, bucket).agg(F.count("*").alias("n"), F.count_if(error).alias("errors")).withColumn("error_rate", F.round(100.0 * F.col("errors") / F.col("n"), 3))


def correct_by(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.sum(F.coalesce("correct", F.lit(False)).cast("int")).alias("correct"), F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("correct") / F.col("n"), 3))


def run_info(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("results"), F.count_if(F.col("error_type").isNotNull()).alias("errors"), F.round(F.sum("inference_ms"), 3).alias("total_ms"))
