"""Rows made from rows: sub-documents, sub-schemas, format conversions, schema variations, synthetic tables,
inferred schemas and generated chunks. Ids come from what a row is made of."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import formats, json_schema, tabular, variation
from weftline.operators import udfs
from weftline.operators.cleaning import drop_duplicate_chunks, first_of, folded
from weftline.storage import materialise, meta, new_id

FORMATS = ("XML", "YAML", "TOML", "MARKDOWN", "PYTHON_STRING", "CSV", "HTML", "SQL")


def seeded(key: Column | str, seed: int = 0) -> Column:
    """60 bits of a digest of key:seed, alike in any engine with md5."""
    text = F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sampled(rows: DataFrame, parent: str, order: Column, share: float) -> DataFrame:
    """max(int(n * share), 1) rows of each parent, without replacement, by the order. The digest decides in place of
    chance, so the sample is the same in every run."""
    w = Window.partitionBy(parent)
    out = rows.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy(order)))
    return out.where(F.col("__k") <= F.greatest(F.floor(F.col("__n") * share), F.lit(1))).drop("__n", "__k")


def sub_documents(rows: DataFrame, *, source: str, depth: int = 7, share: float = 0.2, least: int = 100, most: int | None = None, seed: int = 0) -> DataFrame:
    """Chunks from the objects and lists within JSON rows (id, content): at least `least` characters of JSON, a share
    of each row's. source is documents or chunks, which decides what their parent is; a chunk's own whole is left
    out. With most, exactly that many at the most, by id."""
    parts = rows.where("content is not null").select(F.col("id").alias("parent"), F.col("content").alias("whole"), F.explode(udfs.parts("content", F.lit(depth))).alias("p"))
    parts = parts.select("parent", "p.path", "p.content").where(F.length("content") >= least)
    if source == "chunks":
        parts = parts.where("path != '$'")
    out = first_of(sampled(udfs.spread(parts, "parent"), "parent", F.sha2(F.concat_ws(":", "parent", "path", F.lit(seed)), 256), share).withColumn("id", new_id(F.col("parent"), F.col("path"), "sub")), [folded("content")], "id")
    is_doc = source == "documents"
    info = meta(source=F.lit("extracted_sub_json"), original_chunk_id=F.col("parent")) if not is_doc else meta(source=F.lit("extracted_from_document"), path=F.col("path"))
    none = F.lit(None).cast("string")
    out = out.select("id", "content", F.lit("JSON").alias("content_type"), F.lit(False).alias("is_synthetic"), (F.col("parent") if is_doc else none).alias("parent_document_id"), (none if is_doc else F.col("parent")).alias("parent_chunk_id"), F.lit(False).alias("matches_parent_chunk"), none.alias("schema_id"), info.alias("meta"))
    return out if most is None else out.orderBy("id").limit(most)


def sub_schemas(schemas: DataFrame, most: int | None = None, resolver: json_schema.Resolver = json_schema.no_network) -> DataFrame:
    """Schemas from the definitions and compound parts of schemas, one of each form."""
    parts = schemas.select(F.col("id").alias("parent"), F.col("meta").alias("parent_meta"), F.explode(udfs.schema_parts(resolver)("content")).alias("p")).select("parent", "parent_meta", "p.path", "p.content")
    parts = parts.withColumn("id", new_id(F.col("parent"), F.col("path"), "sub_schema"))
    out = first_of(parts, [udfs.minified("content")], "id")
    info = meta(source=F.lit("extracted_subschema"), original_schema_id=F.col("parent"), extraction_path=F.col("path"), original_schema_meta=F.col("parent_meta"))
    out = out.select("id", "content", F.lit(False).alias("is_synthetic"), F.col("parent").alias("parent_schema_id"), info.alias("meta"))
    return out if most is None else out.orderBy("id").limit(most)


def normalised_schemas(schemas: DataFrame, how: str = "strict", resolver: json_schema.Resolver = json_schema.no_network) -> DataFrame:
    """Schemas with status (updated, skipped, deleted), error, and their content in the strict dialect, or with only
    the references inlined (how = expand); the resolver gets what URLs point to. Written once, so that the Python pass isn't run for each use."""
    told = udfs.schema_status(how, resolver)("content").alias("s")
    out = schemas.select(*schemas.columns, told).select("*", "s.status", "s.error", F.coalesce("s.schema", "content").alias("__c")).withColumn("content", F.col("__c")).drop("s", "__c")
    return materialise(out, "schemas")


def format_conversions(chunks: DataFrame, conversions: DataFrame, names: tuple[str, ...] = FORMATS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(new chunks, new conversions): every JSON chunk with a schema in every format that it isn't in yet and that leads
    back to it. A document is parsed once for all formats, and its texts are exploded after."""
    src = chunks.where("content_type = 'JSON' and schema_id is not null and content is not null").select("id", "content", "schema_id")
    done = conversions.select(F.col("input_chunk_id").alias("__in"), F.col("output_chunk_id").alias("id")).join(chunks.select(F.col("id").alias("__in"), F.col("content_type").alias("format")).where(F.col("format").isin(*names)), "__in")
    done = done.groupBy("id").agg(F.collect_set("format").alias("done"))  # as many as there are formats at most
    wanted = F.array(*[F.lit(n) for n in names])
    todo = src.join(done, "id", "left").withColumn("formats", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
    seeds = F.transform("formats", lambda f: seeded(F.concat_ws(":", "id", f), seed))
    todo = todo.select("id", "schema_id", "content", "formats", seeds.alias("seeds"))
    kinds = [todo.schema[c].dataType.simpleString() for c in ("id", "schema_id")]
    told = todo.mapInArrow(udfs.converted_rows, f"id {kinds[0]}, schema_id {kinds[1]}, format string, text string, options string")
    told = materialise(told, "formats")
    fresh = told.select(new_id(F.col("id"), F.col("format"), "format").alias("id"), F.col("text").alias("content"), F.col("format").alias("content_type"), F.lit(False).alias("is_synthetic"), F.lit(None).cast("string").alias("parent_document_id"), F.col("id").alias("parent_chunk_id"), F.lit(True).alias("matches_parent_chunk"), "schema_id", meta(converter=F.col("format"), converter_state=F.col("options")).alias("meta"))
    fresh = drop_duplicate_chunks(fresh)
    links = fresh.select(new_id(F.col("id"), "conversion").alias("id"), F.col("id").alias("input_chunk_id"), "schema_id", F.col("parent_chunk_id").alias("output_chunk_id"), F.lit(None).cast("bigint").alias("group_id"), F.lit("{}").alias("meta"))
    return fresh, links


def varied_schemas(chunks: DataFrame, schemas: DataFrame, variations: int = 1, seed: int = 0, most: int | None = None) -> DataFrame:
    """(chunk_id, schema_id, number, schema, data, changes): variations of object schemas with the chunk's document
    under each; what doesn't fit is left out. Exactly `most` at the most, by chunk and number."""
    src = chunks.where("content_type = 'JSON' and schema_id is not null").select(F.col("id").alias("chunk_id"), F.col("content").alias("data"), "schema_id").join(schemas.select(F.col("id").alias("schema_id"), F.col("content").alias("schema")), "schema_id")
    src = src.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(variations - 1)))).withColumn("seed", seeded(F.concat_ws(":", "chunk_id", "number"), seed))

    parsed = json_schema.kept(json.loads)  # vary changes copies of it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r in x.itertuples():
                try:
                    old = parsed(r.schema)
                    if json_schema.first_type(old) != "object":
                        continue
                    new, data, changes = variation.vary(old, json.loads(r.data), int(r.seed))
                except (ValueError, TypeError, KeyError, AttributeError):
                    continue
                out.append((r.chunk_id, r.schema_id, r.number, json.dumps(new), json.dumps(data), json.dumps(changes)))
            yield pd.DataFrame(out, columns=["chunk_id", "schema_id", "number", "schema", "data", "changes"])

    made = src.select("chunk_id", "schema_id", "number", "schema", "data", "seed").mapInPandas(run, "chunk_id string, schema_id string, number int, schema string, data string, changes string")
    return made if most is None else made.orderBy("chunk_id", "number").limit(most)


def as_varied_rows(varied: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemas, chunks, conversions) of variations; the conversions lead from the original chunk to the varied."""
    sid, cid = new_id(F.col("chunk_id"), F.col("number"), "varied schema"), new_id(F.col("chunk_id"), F.col("number"), "varied chunk")
    none = F.lit(None).cast("string")
    s = varied.select(sid.alias("id"), F.col("schema").alias("content"), F.lit(True).alias("is_synthetic"), F.col("schema_id").alias("parent_schema_id"), meta(source=F.lit("variation"), changes=F.col("changes")).alias("meta"))
    c = varied.select(cid.alias("id"), F.col("data").alias("content"), F.lit("JSON").alias("content_type"), F.lit(True).alias("is_synthetic"), none.alias("parent_document_id"), F.col("chunk_id").alias("parent_chunk_id"), F.lit(False).alias("matches_parent_chunk"), sid.alias("schema_id"), meta(source=F.lit("variation")).alias("meta"))
    v = varied.select(new_id(F.col("chunk_id"), F.col("number"), "varied conversion").alias("id"), F.col("chunk_id").alias("input_chunk_id"), sid.alias("schema_id"), cid.alias("output_chunk_id"), F.lit(None).cast("bigint").alias("group_id"), F.lit("{}").alias("meta"))
    return s, c, v


def synthetic_tables(source: DataFrame, key: str = "id", seed: int = 0, make: Callable[[int], dict[str, str] | None] = tabular.triplet) -> DataFrame:
    """(key, input_data, content_type, schema, output) for each row of a frame of numbers. `make` is any generator of
    triplets from a seed."""
    src = source.select(F.col(key).cast("long").alias("key"), seeded(F.col(key), seed).alias("seed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(k, t["input_data"], t["content_type"], t["schema"], t["output"]) for k, s in zip(x["key"], x["seed"]) if (t := make(int(s)))]
            yield pd.DataFrame(out, columns=["key", "input_data", "content_type", "schema", "output"])

    return src.mapInPandas(run, "key bigint, input_data string, content_type string, schema string, output string")


def as_synthetic_rows(made: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemas, chunks, conversions) of triplets, all from one row each."""
    made = materialise(made, "synthetic")
    sid, out_id, in_id = (new_id(F.col("key"), F.col("input_data"), t) for t in ("schema", "output", "input"))
    none = F.lit(None).cast("string")
    s = made.select(sid.alias("id"), F.col("schema").alias("content"), F.lit(True).alias("is_synthetic"), none.alias("parent_schema_id"), meta(generator=F.lit("table")).alias("meta"))
    c = made.select(out_id.alias("id"), F.col("output").alias("content"), F.lit("JSON").alias("content_type"), F.lit(True).alias("is_synthetic"), none.alias("parent_document_id"), none.alias("parent_chunk_id"), F.lit(False).alias("matches_parent_chunk"), sid.alias("schema_id"), meta(generator=F.lit("table")).alias("meta")).union(
        made.select(in_id.alias("id"), F.col("input_data"), "content_type", F.lit(True), none, out_id, F.lit(True), sid, meta(generator=F.lit("table")))
    )
    v = made.select(new_id(F.col("key"), F.col("input_data"), "conversion").alias("id"), in_id.alias("input_chunk_id"), sid.alias("schema_id"), out_id.alias("output_chunk_id"), F.lit(None).cast("bigint").alias("group_id"), F.lit("{}").alias("meta"))
    return s, c, v


def inferred_schemas(chunks: DataFrame, provider: Callable[[str], str | None] | None = None, attempts: int = 3) -> DataFrame:
    """(chunk_id, schema): a schema for each JSON chunk without one, checked against it. provider is any function from
    a JSON text to a schema text, a model behind an interface for instance, and is asked up to `attempts` times; without
    one the schema is inferred."""
    src = chunks.where("content_type = 'JSON' and schema_id is null and content is not null").select(F.col("id").alias("chunk_id"), "content")
    stricter = json_schema.kept(lambda schema: json.dumps(json_schema.strict(json.loads(schema))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for cid, text in zip(x["chunk_id"], x["content"]):
                for _ in range(attempts):
                    try:
                        value = json.loads(text)
                        schema = provider(text) if provider else json.dumps(json_schema.infer(value))
                        if schema and json_schema.cached(schema)(value) is None and json_schema.cached(stricter(schema))(value) is None:
                            out.append((cid, schema))
                            break
                    except (ValueError, RecursionError):
                        continue
            yield pd.DataFrame(out, columns=["chunk_id", "schema"])

    return src.mapInPandas(run, "chunk_id string, schema string")


def generated_chunks(schemas: DataFrame, chunks: DataFrame, dangling_only: bool = True, provider: Callable[[str, int], str | None] | None = None) -> DataFrame:
    """(schema_id, content): a document for each schema, by default for those without chunks; valid and not empty."""
    src = schemas.join(chunks.where("schema_id is not null").select(F.col("schema_id").alias("id")), "id", "left_anti") if dangling_only else schemas
    ask = provider or (lambda text, seed: json.dumps(json_schema.instance(json.loads(text), seed)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for sid, text in zip(x["id"], x["content"]):
                try:
                    made = ask(text, formats.seed_of(sid) % 10**6)
                except (ValueError, TypeError, RecursionError):
                    continue
                if made and json.loads(made) and json_schema.check(made, text) is None:
                    out.append((sid, made))
            yield pd.DataFrame(out, columns=["schema_id", "content"])

    return src.select("id", "content").mapInPandas(run, "schema_id string, content string")
