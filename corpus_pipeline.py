"""From raw documents to training shards: language, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last adds each row's shard and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontam, langid, mixing, neardup, sharding
from weftline.session import prepare
from weftline.storage import discard, fresh_path, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identified language. Null texts and texts without letters go, very long ones are read whole,
    rows that repeat an id are decided one by one, equal cosines go to the first language; no rows, or no language to
    learn from, give no rows."""
    prepare(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that with the least id, a null id last. An id with several texts is
    several documents; of rows alike in id and text one stays. Null texts and texts without words all stay, very long
    ones are compared whole; no rows give no rows."""
    prepare(spark)
    return neardup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a passage of the benchmark. Null and empty texts have none and stay, very long ones are searched
    whole, rows that repeat an id are decided one by one; no rows give no rows."""
    prepare(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights, in training order; a document taken twice is there twice. A null source is
    one of its own; null and empty texts have no words and are taken once, if their place is within the target; a very
    long text may be cut at a target's edge; rows alike in id and text are interchangeable; no rows give no rows. The
    order is that of the files' rows; the next stage numbers rows by shard and digest."""
    prepare(spark)
    mixed = mixing.training_order(mixing.mix(docs))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return mixed


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row in a shard, with a slot. Rows of one id, null too, share a shard; null texts count as empty and very
    long ones as they are; rows alike in id and text take any of their slots; no rows give no rows. A column of docs that
    is named as one of the new ones gives way."""
    prepare(spark)
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    placed = sharding.assign(docs)
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: Hyperdimensional profiles can't be stated in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again before the next. What a stage wrote on its way is
    removed when its result is written, and that when the next one is; the last stage's goes with the process."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        docs.written_at = path
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
