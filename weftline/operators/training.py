"""Training preparation: prompts, tokens and label masks, padding, length filters and quantiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scores import MISSING
from weftline.operators.udfs import minified

#: Token ids that a worker hands on together, one text's at least.
LOT = 200_000
SYSTEM = "Turn the text into JSON under the schema. "


def prompt(schema: Column | str = "schema", text: Column | str = "input_data", system: str = SYSTEM) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(system), F.lit("[SCHEMA]"), F.coalesce(c(schema), F.lit(MISSING)), F.lit("[INPUT]"), c(text), F.lit("[OUTPUT]"))


def minified_samples(samples: DataFrame) -> DataFrame:
    """Schema and output minified; other texts, as the missing schema, as they are."""
    return samples.withColumn("schema", minified("schema")).withColumn("output", minified("output"))


def tokens(texts: Column | str, encode: Callable[[str], list[int]]) -> Column:
    """Token ids by any tokenizer's function. They are packed text by text and handed on LOT at a time, as lists of
    numbers take many times the bytes of their text."""

    most = LOT

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            held: list[np.ndarray | None] = []
            size = 0
            for x in s:
                held.append(None if x is None else np.array(encode(x), dtype=np.int32))
                size += 0 if x is None else len(held[-1])
                if size >= most:
                    yield pd.Series(held, dtype=object)
                    held, size = [], 0
            if held or not len(s):
                yield pd.Series(held, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")(texts)


def masked(df: DataFrame, prompt_ids: str, target_ids: str, bos: int, eos: int) -> DataFrame:
    """input_ids = begin, prompt, target, end; labels with -100 for begin and prompt; attention_mask of ones."""
    ids = F.concat(F.array(F.lit(bos)), prompt_ids, target_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids) + 1), target_ids, F.array(F.lit(eos)))
    return df.withColumn("input_ids", ids).withColumn("labels", labels).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("length", F.size("input_ids"))


def within_length(df: DataFrame, most: int | None) -> DataFrame:
    """Rows of at most `most` tokens; None keeps all."""
    return df if most is None else df.where(F.size("input_ids") <= most)


def reverted_if_long(df: DataFrame, most: int, columns: tuple[str, ...] = ("input_ids", "labels")) -> DataFrame:
    """Where the augmented row is too long, its original: columns and their original_ twins."""
    long = F.size("input_ids") > most
    return df.withColumns({c: F.when(long, F.col("original_" + c)).otherwise(F.col(c)) for c in columns})


def padded(df: DataFrame, batch: str, pad: int, multiple: int = 8) -> DataFrame:
    """Rows padded at the right to their batch's longest, rounded up to a multiple; labels with -100, mask with 0."""
    top = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    width = (F.ceil(top / multiple) * multiple).cast("int")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("__width") - F.size(c)))
    return df.withColumn("__width", width).withColumns({"input_ids": fill("input_ids", pad), "labels": fill("labels", -100), "attention_mask": fill("attention_mask", 0)}).drop("__width")


def length_quantiles(df: DataFrame, length: Column | str, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Quantiles with linear interpolation, to 3 places."""
    c = F.col(length) if isinstance(length, str) else length
    q = F.percentile(c, F.array(*[F.lit(x) for x in at]))
    return df.agg(q.alias("q")).select(*[F.round(F.element_at("q", i + 1), 3).alias(f"p{round(x * 100)}") for i, x in enumerate(at)])


def floor_percentile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value of rank int((n - 1) * q) in each group. Ranks come from counts of the distinct values, pre-aggregated,
    so a group is never collected into one array; 0 for a group of nulls."""
    counts = df.groupBy(group, value).agg(F.count(value).alias("n"))
    w = Window.partitionBy(group)
    upto = F.sum("n").over(w.orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(w))
    rank = F.floor((F.col("total") - 1) * F.lit(q))
    return ranked.groupBy(group).agg(F.coalesce(F.min(F.when((F.col("upto") > rank) & (F.col("n") > 0), F.col(value))), F.lit(0)).alias("value"))
