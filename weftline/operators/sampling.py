"""Samples for export: eligible conversions as samples, missing-schema copies, negatives, augmentation. A digest of the
id takes the place of chance, so samples are the same in every run and every engine."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import json_schema, variation
from weftline.functions.scores import MISSING
from weftline.operators.cleaning import eligible_for_export, expanded
from weftline.storage import materialise

META = "struct<input_chunk_id:string,input_chunk_content_type:string,output_chunk_id:string,schema_id:string,schema_conversion_id:string,is_test:boolean,group:bigint,is_synthetic:boolean,synthetic_type:string,original_schema_id:string>"
SAMPLE = f"input_data string, schema string, output string, meta {META}"


def digest(key: Column | str, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.col(key) if isinstance(key, str) else key, F.lit(seed)), 256)


def shuffled(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """The first n rows in the order of the key's digest."""
    return df.orderBy(digest(key, seed), key).limit(n)


def export_samples(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame, split: DataFrame, limit: int | None = None) -> DataFrame:
    """Samples of the eligible conversions; split says which groups are test groups."""
    rows = eligible_for_export(conversions, chunks)
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    rows = expanded(rows, chunks, schemas).join(chunks.select(F.col("id").alias("input_chunk_id"), F.col("content_type").alias("input_type")), "input_chunk_id").join(split.select("group_id", "is_test"), "group_id", "left")
    none = F.lit(None).cast("string")
    meta = F.struct(F.col("input_chunk_id"), F.col("input_type").alias("input_chunk_content_type"), F.col("output_chunk_id"), F.col("schema_id"), F.col("id").alias("schema_conversion_id"), F.coalesce("is_test", F.lit(False)).alias("is_test"), F.col("group_id").alias("group"), F.lit(False).alias("is_synthetic"), none.alias("synthetic_type"), none.alias("original_schema_id"))
    return rows.select(F.col("input_content").alias("input_data"), F.col("schema_content").alias("schema"), F.col("output_content").alias("output"), meta.alias("meta"))


def first_share(df: DataFrame, key: Column, share: float, seed: str) -> DataFrame:
    """int(share * rows) rows in the order of a digest. Rows are numbered by a range sort, not by one task."""
    from weftline.operators.numbering import numbered

    n = df.count()
    placed = numbered(df.withColumn("__d", digest(key, seed)), [F.col("__d")], "__k")
    return placed.where(F.col("__k") < int(n * share)).drop("__d", "__k")


def missing_schema_samples(samples: DataFrame, share: float = 0.1, seed: str = "missing") -> DataFrame:
    """Copies of test samples with no schema told."""
    out = first_share(samples.where("meta.is_test"), F.col("meta.schema_conversion_id"), share, seed)
    return out.withColumn("schema", F.lit(MISSING)).withColumn("meta", F.col("meta").withField("is_synthetic", F.lit(True)).withField("synthetic_type", F.lit("missing_schema")))


def _others(samples: DataFrame) -> DataFrame:
    """(sid, schema, place): the samples' own distinct schemas, numbered in the order of a digest."""
    from weftline.operators.numbering import numbered

    own = samples.where(F.col("schema") != MISSING).select("schema", F.coalesce("meta.schema_id", "schema").alias("sid"))
    own = own.groupBy("sid").agg(F.min("schema").alias("schema"))
    return numbered(own, [digest("sid", "negative"), F.col("sid")], "place")


def _candidates(rows: DataFrame, others: DataFrame, tries: int, draw: Column) -> DataFrame:
    """(k, candidates): for each row `tries` of the schemas, the draw's and those 7919 places on each time. Every schema
    can be drawn, however many there are: rows and schemas meet by place, and no list of schemas reaches the driver."""
    n = others.agg(F.max("place") + 1).first()[0]
    if not n:
        return rows.select("k").limit(0).withColumn("candidates", F.array().cast("array<struct<t:int,sid:string,schema:string>>"))
    asked = rows.select("k", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"), draw.alias("__draw"))
    asked = asked.select("k", "t", F.pmod(F.col("__draw") + F.col("t") * 7919, F.lit(n)).alias("place"))
    met = asked.join(others, "place").select("k", F.struct("t", "sid", "schema").alias("c"))
    return met.groupBy("k").agg(F.sort_array(F.collect_list("c")).alias("candidates"))  # `tries` a row


def negative_samples(samples: DataFrame, share: float = 0.25, tries: int = 3, seed: str = "negative") -> DataFrame:
    """A share of the samples with a schema that their output doesn't fit and the empty result. Candidates come from all
    distinct schemas of the samples; each sample tries `tries` of them, chosen by its own digest, and is left out if it
    fits them all."""
    chosen = first_share(samples.where(F.col("schema") != MISSING), F.col("meta.schema_conversion_id"), share, seed)
    chosen = materialise(chosen.withColumn("k", F.monotonically_increasing_id()), "chosen")
    near = _candidates(chosen, _others(samples), tries, F.conv(F.substring(digest("meta.schema_conversion_id", seed + "-draw"), 1, 10), 16, 10).cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r in x.itertuples():
                for c in r.candidates:
                    if c["sid"] != r.sid and json_schema.check(r.output, c["schema"]) is not None:
                        out.append((r.k, c["sid"], c["schema"], json.dumps(json_schema.null_result(json.loads(c["schema"])))))
                        break
            yield pd.DataFrame(out, columns=["k", "sid", "other", "empty"])

    rows = chosen.select("k", F.coalesce("meta.schema_id", "schema").alias("sid"), "output").join(near, "k")
    found = rows.mapInPandas(run, "k bigint, sid string, other string, empty string")
    out = chosen.join(found, "k")
    meta = F.col("meta").withField("is_synthetic", F.lit(True)).withField("synthetic_type", F.lit("negative")).withField("original_schema_id", F.col("meta.schema_id")).withField("schema_id", F.col("sid"))
    return out.select("input_data", F.col("other").alias("schema"), F.col("empty").alias("output"), meta.alias("meta"))


def augmented(samples: DataFrame, others: list[str] | None = None, chances: tuple[float, ...] = (0.1, 0.1, 0.5, 0.1), seed: int = 0, steps: list[tuple[variation.Step, float]] | None = None, tries: int = 2) -> DataFrame:
    """Training samples with the steps negative, no schema, varied schema, presentation, each by its chance; or with
    any other steps. The negative step tries `tries` schemas of `others`, or else of all distinct schemas of the samples.
    Original columns are kept as original_schema, original_output, original_input."""
    src = samples.withColumn("__seed", F.pmod(F.xxhash64("input_data", "schema", F.lit(seed)), F.lit(1 << 40)))
    if others is None and steps is None:
        src = materialise(src.withColumn("k", F.monotonically_increasing_id()), "augmented")
        asked = src.where((F.col("schema") != MISSING) & (F.col("__seed") % 1000 < 1000 * chances[0]))
        src = src.join(_candidates(asked, _others(samples), tries, F.shiftright("__seed", 10)), "k", "left").drop("k")
    else:
        src = src.withColumn("candidates", F.lit(None).cast("array<struct<t:int,sid:string,schema:string>>"))
    later = [(variation.step_drop_schema, chances[1]), (variation.step_present, chances[2]), (variation.step_vary, chances[3])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for a, b, c, s, near in zip(x["input_data"], x["schema"], x["output"], x["__seed"], x["candidates"]):
                # Rows with candidates are those that the negative step's chance has chosen.
                own = [(variation.step_negative(others), chances[0])] if others is not None else [(variation.step_negative([c["schema"] for c in near], in_order=True), 1.0)] if near is not None else []
                rows.append(variation.augmented({"input_data": a, "schema": b, "output": c}, int(s), steps or own + later))
            for k in ("input_data", "schema", "output"):
                x["original_" + k.removesuffix("_data")] = x[k]
                x[k] = [r[k] for r in rows]
            yield x.drop(columns=["__seed", "candidates"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema.fields)
    return src.mapInPandas(run, f"{kinds}, original_input string, original_schema string, original_output string")
