"""Filters, duplicates, dangling and broken rows, repairs and counts. All relational: Catalyst plans them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.udfs import schema_ok, validation_error


def folded(text: Column | str) -> Column:
    """Lower case without blanks at the ends; all white space counts as blank."""
    c = F.col(text) if isinstance(text, str) else text
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


# Filters


def json_chunks(chunks: DataFrame, with_schema: bool | None = None, synthetic: bool | None = None) -> DataFrame:
    """JSON chunks with content; optionally only those with or without a schema, synthetic or not."""
    out = chunks.where((F.col("content_type") == "JSON") & F.col("content").isNotNull() & (F.col("content") != ""))
    if with_schema is not None:
        out = out.where(F.col("schema_id").isNotNull() == F.lit(with_schema))
    return out if synthetic is None else out.where(F.col("is_synthetic") == F.lit(synthetic))


def page(df: DataFrame, key: str, limit: int, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """Rows offset .. offset + limit by key."""
    return df.orderBy(F.col(key).desc() if newest_first else F.col(key)).offset(offset).limit(limit)


def cull_by_length(df: DataFrame, low: int = 5, high: int = 4000, text: str = "content") -> DataFrame:
    """Rows whose text is longer than low and shorter than high."""
    return df.where((F.length(text) > low) & (F.length(text) < high))


def where_json(df: DataFrame, path: str, value: str | None = None, column: str = "meta") -> DataFrame:
    """Rows whose JSON column has a value, or the given one, at a path."""
    at = F.get_json_object(column, path)
    return df.where(at.isNotNull() if value is None else at == value)


def delete_where_json(df: DataFrame, content_type: str, path: str, value: str) -> DataFrame:
    """What is left after deleting the rows of a content type with a value at a path of meta."""
    hit = (F.col("content_type") == content_type) & (F.get_json_object("meta", path) == value)
    return df.where(~F.coalesce(hit, F.lit(False)))


def by_content_type(df: DataFrame, kind: str = "All") -> DataFrame:
    return df if kind == "All" else df.where(F.col("content_type") == kind)


def only_errors(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce("correct", F.lit(False)))


# Duplicates


def first_of(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row by `order` of each key. The keys are hashed, so long texts don't take part in the sort; a row
    number with a limit of 1 is cut down within each partition before the shuffle, so hot keys stay small."""
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0000")) for k in keys]), 256)
    w = Window.partitionBy("__key").orderBy(order)
    return df.withColumn("__key", digest).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__key", "__n")


def duplicated(df: DataFrame, key: Column, having: int = 1) -> DataFrame:
    """Keys that more than `having` rows have, with their counts."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > having)


def any_row_of(df: DataFrame, keys: list[str], order: str, only_repeated: bool = True) -> DataFrame:
    """A GROUP BY with bare columns: one whole row for each value of the keys, by default of those met more than once.
    Which row such a query gives is left open; here it is the least by `order`, so that reruns agree."""
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("__row"), F.count("*").alias("__n"))
    return rows.where("__n > 1" if only_repeated else "true").select("__row.*")


def two_stage_survivors(df: DataFrame, exact: Column, fold: Column, order: str) -> DataFrame:
    """(id, survivor): only rows whose exact text occurs several times are candidates; of those with one folded text
    the first survives. So {A, A, a, a} keeps one row and {A, a} two. One row per row of df."""
    rows = df.select(F.col(order).alias("id"), F.sha2(exact.cast("string"), 256).alias("__exact"), F.sha2(fold.cast("string"), 256).alias("__fold"))
    counts = rows.groupBy("__exact").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    found = rows.join(counts, "__exact", "left_semi").groupBy("__fold").agg(F.min("id").alias("__first"))
    marked = rows.join(counts.withColumn("__dup", F.lit(True)), "__exact", "left").join(found, "__fold", "left")
    return marked.select("id", F.when(F.col("__dup"), F.col("__first")).otherwise(F.col("id")).alias("survivor"))


def drop_duplicates(df: DataFrame, exact: Column, fold: Column, order: str = "id") -> DataFrame:
    """df without the rows that a two-stage survivor stands for."""
    gone = two_stage_survivors(df, exact, fold, order).where("id != survivor").select(F.col("id").alias("__gone"))
    return df.join(gone, F.col(order) == F.col("__gone"), "left_anti")


def drop_duplicate_documents(documents: DataFrame) -> DataFrame:
    """By metadata with source, then by content within a source."""
    out = drop_duplicates(documents, F.col("meta"), F.concat_ws("\u0001", "meta", "source"))
    return drop_duplicates(out, F.col("content"), F.concat_ws("\u0001", "source", folded("content")))


def drop_duplicate_chunks(chunks: DataFrame) -> DataFrame:
    return drop_duplicates(chunks, F.col("content"), folded("content"))


def drop_duplicate_schemas(schemas: DataFrame, chunks: DataFrame, conversions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Schemas without duplicates; chunks and conversions point to the survivors."""
    to = two_stage_survivors(schemas, F.col("content"), F.col("content"), "id").where("id != survivor").select(F.col("id").alias("__old"), F.col("survivor").alias("__new"))

    def repointed(df: DataFrame) -> DataFrame:
        return df.join(to, df["schema_id"] == to["__old"], "left").withColumn("schema_id", F.coalesce("__new", "schema_id")).drop("__old", "__new")

    return schemas.join(to, schemas["id"] == to["__old"], "left_anti"), repointed(chunks), repointed(conversions)


# Dangling, broken


def dangling_schemas(schemas: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Schemas that no chunk has; with a limit the first by id."""
    out = schemas.join(chunks.where("schema_id is not null").select(F.col("schema_id").alias("id")), "id", "left_anti")
    return out if limit is None else out.orderBy("id").limit(limit)


def drop_dangling_schemas(schemas: DataFrame, chunks: DataFrame) -> DataFrame:
    return schemas.join(chunks.select(F.col("schema_id").alias("id")), "id", "left_semi")


def drop_broken_schemas(schemas: DataFrame) -> DataFrame:
    return schemas.where(schema_ok("content"))


def documents_without_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.join(chunks.select(F.col("parent_document_id").alias("id")), "id", "left_anti")


def documents_without_chunks_null_aware(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """NOT IN as SQL has it: no row if any chunk lacks a document."""
    orphans = chunks.where("parent_document_id is null").select(F.lit(1).alias("__x")).limit(1)
    return documents_without_chunks(documents, chunks).join(F.broadcast(orphans), F.lit(True), "left_anti")


def drop_format(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame, kind: str = "XML") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the conversions whose input has a format, with their input and output chunks and schemas."""
    hit = conversions.join(chunks.where(F.col("content_type") == kind).select(F.col("id").alias("input_chunk_id")), "input_chunk_id", "left_semi")
    gone = hit.select(F.explode(F.array("input_chunk_id", "output_chunk_id")).alias("id")).distinct()
    return conversions.join(hit.select("id"), "id", "left_anti"), chunks.join(gone, "id", "left_anti"), schemas.join(hit.select(F.col("schema_id").alias("id")), "id", "left_anti")


def clear_broken_mappings(chunks: DataFrame, schemas: DataFrame) -> DataFrame:
    """Null the schema of chunks whose schema is missing or that aren't valid under it."""
    s = schemas.select(F.col("id").alias("schema_id"), F.col("content").alias("__schema"))
    out = chunks.join(s, "schema_id", "left").withColumn("__why", F.when(F.col("__schema").isNotNull(), validation_error("content", "__schema")))
    keep = F.col("__schema").isNotNull() & F.col("__why").isNull()
    return out.withColumn("schema_id", F.when(keep, F.col("schema_id"))).select(*chunks.columns)


def invalid_conversions(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame) -> DataFrame:
    """Conversions of which a reference leads nowhere."""
    have = lambda df, key: df.select(F.col("id").alias(key), F.lit(True).alias(f"__{key}"))
    out = conversions.join(have(chunks, "input_chunk_id"), "input_chunk_id", "left").join(have(chunks, "output_chunk_id"), "output_chunk_id", "left").join(have(schemas, "schema_id"), "schema_id", "left")
    return out.where("__input_chunk_id is null or __output_chunk_id is null or __schema_id is null").select(*conversions.columns)


def fix_conversions(conversions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Take the schema of the output chunk where it has another."""
    out = chunks.select(F.col("id").alias("output_chunk_id"), F.col("schema_id").alias("__own"))
    return conversions.join(out, "output_chunk_id", "left").withColumn("schema_id", F.when(F.col("__own") != F.col("schema_id"), F.col("__own")).otherwise(F.col("schema_id"))).select(*conversions.columns)


def mismatched_conversions(conversions: DataFrame, chunks: DataFrame) -> DataFrame:
    out = chunks.select(F.col("id").alias("output_chunk_id"), F.col("schema_id").alias("chunk_schema_id"))
    return conversions.join(out, "output_chunk_id").where("schema_id != chunk_schema_id")


def clear_content(documents: DataFrame) -> DataFrame:
    return documents.withColumn("content", F.lit(""))


def delete_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete documents by id, and their chunks with them."""
    ids = gone.select("id")
    return documents.join(ids, "id", "left_anti"), chunks.join(ids.withColumnRenamed("id", "parent_document_id"), "parent_document_id", "left_anti").select(*chunks.columns)


# Joins and counts


def expanded(conversions: DataFrame, chunks: DataFrame, schemas: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """Conversions with the contents of input, output and schema; outputs are chunks too, or lie in a table of their own.
    Both joins with chunks are told to merge: by the size of its files a small table of chunks would be broadcast, texts
    and all, and what is shuffled would jump once it is larger. Schemas are left to Spark and come last, so that their
    texts aren't shuffled on."""
    side = lambda df, key, name: df.select(F.col("id").alias(key), F.col("content").alias(name))
    out = conversions.join(side(chunks, "input_chunk_id", "input_content").hint("merge"), "input_chunk_id")
    out = out.join(side(chunks if outputs is None else outputs, "output_chunk_id", "output_content").hint("merge"), "output_chunk_id")
    return out.join(side(schemas, "schema_id", "schema_content"), "schema_id")


def eligible_for_export(conversions: DataFrame, chunks: DataFrame, legacy_drop_group0: bool = False) -> DataFrame:
    """Conversions with all references, a group, and a JSON output. The legacy flag drops group 0 too."""
    out = conversions.where("input_chunk_id is not null and schema_id is not null and output_chunk_id is not null and group_id is not null")
    if legacy_drop_group0:
        out = out.where("group_id != 0")
    return out.join(chunks.where("content_type = 'JSON'").select(F.col("id").alias("output_chunk_id")), "output_chunk_id", "left_semi")


def covered_formats(conversions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(output_chunk_id, formats) that a chunk has already been converted to."""
    c = chunks.select(F.col("id").alias("input_chunk_id"), "content_type")
    return conversions.join(c, "input_chunk_id").groupBy("output_chunk_id").agg(F.sort_array(F.collect_set("content_type")).alias("formats"))


def overview(documents: DataFrame, chunks: DataFrame, schemas: DataFrame, conversions: DataFrame) -> DataFrame:
    """All counts in one row; one pass over each table."""
    one = lambda df, **aggs: df.agg(*[v.alias(k) for k, v in aggs.items()])
    parts = [one(documents, documents=F.count("*")), one(chunks, chunks=F.count("*"), chunks_with_schema=F.count("schema_id"), synthetic_chunks=F.count_if("is_synthetic"), used_schemas=F.count_distinct("schema_id")), one(schemas, schemas=F.count("*"), synthetic_schemas=F.count_if("is_synthetic")), one(conversions, conversions=F.count("*"), conversions_with_group=F.count("group_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out


def count_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
