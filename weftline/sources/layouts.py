"""Readers of dataset layouts: each turns a dataset's records into documents, chunks, schemas and conversions. The
registry finds a layout by the last two parts of a path, in lower case."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import udfs
from weftline.operators.cleaning import first_of
from weftline.storage import materialise, meta, new_id

Tables = dict[str, DataFrame]


def _none() -> Column:
    return F.lit(None).cast("string")


def documents(rows: DataFrame, source: str, content: Column, index: Column, kind: str = "JSON") -> DataFrame:
    info = meta(source_dataset_name=F.lit(source), source_dataset_index=index)
    return rows.select(new_id(F.lit(source), index.cast("string"), content).alias("id"), F.lit(source).alias("source"), content.alias("content"), F.lit(kind).alias("content_type"), info.alias("meta"))


#: The column that tells a record's place in its source.
PLACE = "__place"


def in_source_order(rows: DataFrame) -> DataFrame:
    """Rows as read from files, with each record's place: the file, the split of the file and the order in it. Layouts
    number records by it, so that an index is the record's own and the first of equal records is the first in the source."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias(PLACE))


def indexed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with __index from 0: their own if they have one, else by place if there is one, else by content."""
    from weftline.operators.numbering import numbered

    if "__index" in rows.columns:
        return rows
    if PLACE in rows.columns:
        return numbered(rows, [F.col(PLACE)], "__index").drop(PLACE)
    return numbered(rows, order, "__index")


def _place(rows: DataFrame) -> list[str]:
    return [c for c in (PLACE, "__index") if c in rows.columns]


def raw_records(rows: DataFrame, source: str, limit: int | None = None) -> Tables:
    """One document per record; with a limit the first ones, exactly as many."""
    told = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != PLACE])).alias("content"), *_place(rows))
    told = indexed(told, [F.col("content")])
    if limit is not None:
        told = told.where(F.col("__index") < limit)
    return {"source_documents": documents(told, source, F.col("content"), F.col("__index"))}


def schema_and_answer(rows: DataFrame, source: str, schema_col: str = "schema", answer_col: str = "response", limit: int | None = None) -> Tables:
    """A document and a chunk per answer, with the schema brought to the strict dialect if it is of good quality and
    the answer fits it. Documents and chunks stay when the schema doesn't; `status` says so."""
    src = indexed(rows.select(F.col(schema_col).alias("s"), F.col(answer_col).alias("a"), *_place(rows)), [F.col("s"), F.col("a")])
    if limit is not None:
        src = src.where(F.col("__index") < limit)
    told = udfs.spread(src, "__index").select("*", udfs.strict(F.replace(F.col("s"), F.lit('"definitions"'), F.lit('"$defs"'))).alias("n"))
    told = told.select("__index", "s", "a", "n.schema", udfs.schema_quality("n.schema").alias("good"), udfs.validation_error_without_formats("a", "n.schema").alias("why"))
    told = materialise(told.withColumn("status", F.when(F.col("schema").isNull(), "no strict schema").when(~F.coalesce("good", F.lit(False)), "low quality").when(F.col("why").isNotNull(), "answer doesn't fit").otherwise("ok")), "layout")
    ok = F.col("status") == "ok"
    docs = documents(told, source, F.col("a"), F.col("__index"))
    sid, did = new_id(F.lit(source), F.col("__index").cast("string"), "schema"), new_id(F.lit(source), F.col("__index").cast("string"), F.col("a"))
    info = meta(source_dataset_name=F.lit(source), source_dataset_index=F.col("__index"), status=F.col("status"))
    chunks = told.select(new_id(did, "chunk").alias("id"), F.col("a").alias("content"), F.lit("JSON").alias("content_type"), F.lit(False).alias("is_synthetic"), did.alias("parent_document_id"), _none().alias("parent_chunk_id"), F.lit(False).alias("matches_parent_chunk"), F.when(ok, sid).alias("schema_id"), info.alias("meta"))
    schemas = told.where(ok).select(sid.alias("id"), F.col("schema").alias("content"), F.lit(False).alias("is_synthetic"), _none().alias("parent_schema_id"), info.alias("meta"))
    return {"source_documents": docs, "chunks": chunks, "json_schemas": schemas, "status": told.groupBy("status").agg(F.count("*").alias("n"))}


def conversations(rows: DataFrame, source: str, turns: str = "conversations", schema_col: str = "schema", longest: int = 10_000, limit: int | None = None) -> Tables:
    """The last turn's text after its thoughts is the answer. Long ones are left out, and of rows with an answer or a
    schema seen before, in order, only the first is taken. Indexes are those of the records, whatever is left out."""
    last = F.element_at(F.col(turns), -1)["value"]
    told = rows.select(F.trim(F.substring_index(last, "</think>", -1)).alias("answer"), F.col(schema_col).alias("schema"), *_place(rows))
    told = indexed(told, [F.col("answer"), F.col("schema")]).where((F.length("answer") <= longest) & (F.length("schema") <= longest))
    told = first_of(first_of(told, [F.col("answer")], "__index"), [F.col("schema")], "__index")
    return schema_and_answer(told, source, "schema", "answer", limit)


def schemas_only(rows: DataFrame, source: str, schema_col: str = "schema", limit: int | None = None, longest: int = 10_000) -> Tables:
    """Schemas of good quality in the strict dialect, one of each text, with the index of the first that has it."""
    src = indexed(rows.select(F.col(schema_col).alias("s"), *_place(rows)), [F.col("s")]).where(F.length("s") <= longest)
    src = src.groupBy("s").agg(F.min("__index").alias("__index"))
    if limit is not None:
        src = src.where(F.col("__index") < limit)
    told = src.select("*", udfs.strict("s").alias("n")).select("__index", "n.schema").where("schema is not null").where(udfs.schema_quality("schema"))
    info = meta(source_dataset_name=F.lit(source), source_dataset_index=F.col("__index"))
    return {"json_schemas": told.select(new_id(F.lit(source), F.col("__index").cast("string"), "schema").alias("id"), F.col("schema").alias("content"), F.lit(False).alias("is_synthetic"), _none().alias("parent_schema_id"), info.alias("meta"))}


def schema_store(spark: SparkSession, folder: str, source: str = "schemastore") -> Tables:
    """A tree with schemas/<name>.json and tests/<name>/<file>: instances in other formats become an input chunk, a
    parsed output chunk and a conversion."""
    files = lambda part: spark.read.text(f"{folder}/{part}", wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    s = files("schemas").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), udfs.strict("text").alias("n")).select("name", "n.schema").where("schema is not null")
    sid = new_id(F.lit(source), F.col("name"), "schema")
    info = meta(source_dataset_name=F.lit(source), source_dataset_index=F.col("name"))
    schemas = s.select(sid.alias("id"), F.col("schema").alias("content"), F.lit(False).alias("is_synthetic"), _none().alias("parent_schema_id"), info.alias("meta"))
    t = files("tests").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name"), F.upper(F.regexp_extract("path", r"\.([a-z]+)$", 1)).alias("ext"), "path", "text").withColumn("kind", F.when(F.col("ext") == "YML", "YAML").otherwise(F.col("ext"))).where(F.col("kind").isin("JSON", "YAML", "TOML"))
    told = materialise(t.withColumn("value", udfs.as_json("text", "kind")).where("value is not null").join(s, "name").withColumn("why", udfs.validation_error("value", "schema")).where("why is null"), "store")
    out_id, in_id = new_id(F.lit(source), F.col("name"), F.element_at(F.split("path", "/"), -1), "output"), new_id(F.lit(source), F.col("name"), F.element_at(F.split("path", "/"), -1), "input")
    out = told.select(out_id.alias("id"), F.col("value").alias("content"), F.lit("JSON").alias("content_type"), F.lit(False).alias("is_synthetic"), _none().alias("parent_document_id"), _none().alias("parent_chunk_id"), F.lit(False).alias("matches_parent_chunk"), sid.alias("schema_id"), info.alias("meta"))
    other = told.where("kind != 'JSON'")
    inputs = other.select(in_id.alias("id"), F.col("text").alias("content"), F.col("kind").alias("content_type"), F.lit(False).alias("is_synthetic"), _none().alias("parent_document_id"), out_id.alias("parent_chunk_id"), F.lit(True).alias("matches_parent_chunk"), sid.alias("schema_id"), info.alias("meta"))
    links = other.select(new_id(in_id, "conversion").alias("id"), in_id.alias("input_chunk_id"), sid.alias("schema_id"), out_id.alias("output_chunk_id"), F.lit(None).cast("bigint").alias("group_id"), info.alias("meta"))
    return {"json_schemas": schemas, "chunks": out.unionByName(inputs), "schema_conversions": links}


LAYOUTS: dict[str, Callable[..., Tables]] = {
    "wikimedia/structured-wikipedia": raw_records, "generic/records": raw_records, "christian-azinn/json-training": schema_and_answer, "generic/schema-answer": schema_and_answer, "interstellarninja/json-mode-reasoning": conversations, "generic/conversations": conversations,
    "dataunitylab/json-schema": lambda rows, source, **k: schemas_only(rows, source, **{"schema_col": "content", **k}), "dataunitylab/json-schema-keywords": schemas_only, "generic/schemas": schemas_only, "schemastore/schemastore": schema_store,
}


def layout_id(path: str) -> str:
    *_, owner, name = path.rstrip("/").lower().split("/")
    return f"{owner}/{name}"


def layout_of(path: str) -> Callable[..., Tables]:
    if (key := layout_id(path)) not in LAYOUTS:
        raise KeyError(f"no layout for {key}; known: {', '.join(sorted(LAYOUTS))}")
    return LAYOUTS[key]
