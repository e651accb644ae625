"""Arrow-batched functions over text columns, for what no built-in expression can tell. Each is null for null input
and never fails: what goes wrong in a row is told in the row."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import formats, json_schema, json_values, scores
from weftline.functions.json_values import or_none


STRING, BOOLEAN, LONG, DOUBLE = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
PARTS = T.ArrayType(T.StructType([T.StructField("path", STRING), T.StructField("content", STRING)]))


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df in as many parts as the session's shuffles have, by a digest of the keys, or else evenly: ahead of costly
    functions, as a small file, or one of a single row group, is one task, and narrow rows are few."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def struct_of(**members: T.DataType) -> T.StructType:
    """Types as objects: unlike type texts they need no session when a module is imported."""
    return T.StructType([T.StructField(k, v) for k, v in members.items()])


def text_function(f: Callable[[str], Any], kind: T.DataType = T.StringType()) -> Callable[..., Column]:
    """A function of one text as a column function."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else f(x) for x in s], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


minified = text_function(json_values.minified_text)
index_text = text_function(or_none(lambda x: json_values.index_text(json.loads(x))))
null_free = text_function(or_none(lambda x: json.dumps(json_values.without_nulls(json.loads(x)))))
blocks = text_function(lambda x: [json.dumps(v) for v in json_values.fenced(x)], T.ArrayType(STRING))
uncommented = text_function(json_values.without_comments)
schema_ok = text_function(json_schema.compiles, BOOLEAN)
schema_quality = text_function(json_schema.kept(lambda x: bool(or_none(lambda y: json_schema.good_quality(json.loads(y)))(x))), BOOLEAN)
inferred = text_function(or_none(lambda x: json.dumps(json_schema.infer(json.loads(x)))))
null_result = text_function(or_none(lambda x: json.dumps(json_schema.null_result(json.loads(x)))))


def struct_function(f: Callable[..., dict[str, Any]], kind: T.StructType) -> Callable[..., Column]:
    """A function of texts that gives a struct."""
    names = kind.fieldNames()

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame([f(*row) for row in zip(*cols)], columns=names, dtype=object)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([f(x) for x in s], columns=names, dtype=object)

    import inspect

    single = len([p for p in inspect.signature(f).parameters.values() if p.default is p.empty]) == 1
    chosen = one if single else run
    chosen.__annotations__ = {"batches": Iterator[pd.Series] if single else Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(chosen, kind)


_STATUS = struct_of(schema=STRING, status=STRING, error=STRING)


def schema_status(how: str, resolver: json_schema.Resolver = json_schema.no_network) -> Callable[..., Column]:
    """Schema texts brought to the strict dialect, or with references inlined (how = expand); the resolver, a function that
    workers can get, finds what URLs point to. A worker tells each of the last thousand texts once."""
    told = json_schema.kept(lambda x: json_schema.status(x, how, resolver))
    return struct_function(lambda x: told(x), _STATUS)


strict, expand = schema_status("strict"), schema_status("expand")


@F.pandas_udf(STRING)
def validation_error(values: pd.Series, schemas: pd.Series) -> pd.Series:
    """What is wrong with a JSON text under a schema text; null if nothing. A worker compiles each schema once."""
    return pd.Series([json_schema.check(v, s) for v, s in zip(values, schemas)], dtype=object)


@F.pandas_udf(STRING)
def validation_error_without_formats(values: pd.Series, schemas: pd.Series) -> pd.Series:
    """The same, whatever the formats of texts: for answers that come with their schemas."""
    return pd.Series([json_schema.check(v, s, formats=False) for v, s in zip(values, schemas)], dtype=object)


def _converted(value: object, name: str, seed: int) -> tuple[str | None, str, str | None]:
    try:
        text, options, error = formats.converted(value, name, seed)
        return text, json.dumps(options), error
    except (ValueError, TypeError) as e:
        return None, "{}", str(e)[:200]


@F.pandas_udf(struct_of(text=STRING, options=STRING, error=STRING))
def convert(values: pd.Series, names: pd.Series, seeds: pd.Series) -> pd.DataFrame:
    """A JSON text in a format: the text, the format's options, or why it can't be told."""
    out = []
    for v, n, s in zip(values, names, seeds):
        try:
            out.append(_converted(json.loads(v), n, int(s)))
        except (ValueError, TypeError) as e:
            out.append((None, "{}", str(e)[:200]))
    return pd.DataFrame(out, columns=["text", "options", "error"], dtype=object)


#: Documents whose texts are handed on together: each has as many as there are formats.
LOT = 500


def converted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, schema_id, content, formats, seeds) to (id, schema_id, format, text, options) for each format that leads
    back. A document is parsed once; what isn't JSON has no rows."""
    for whole in batches:
        for start in range(0, whole.num_rows, LOT):
            x = whole.slice(start, LOT)
            out: list[tuple[int, str, str | None, str]] = []
            for i, (v, own, draws) in enumerate(zip(*(x.column(c).to_pylist() for c in ("content", "formats", "seeds")))):
                try:
                    value = json.loads(v)
                except (ValueError, TypeError, RecursionError):
                    continue
                for n, s in zip(own, draws):
                    text, options, error = _converted(value, n, s)
                    if error is None:
                        out.append((i, n, text, options))
            at, *told = zip(*out) if out else ((), (), (), ())
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([x.column("id").take(at), x.column("schema_id").take(at), *(pa.array(c, pa.string()) for c in told)], ["id", "schema_id", "format", "text", "options"])


@F.pandas_udf(STRING)
def sorted_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of a text's characters in order. They are counted, so that no list of single characters is made."""
    out = []
    for t in texts:
        if t is None:
            out.append(None)
        else:
            counts = Counter(t)
            out.append(hashlib.sha256("".join([c * counts[c] for c in sorted(counts)]).encode()).hexdigest())
    return pd.Series(out, dtype=object)


@F.pandas_udf(PARTS)
def parts(values: pd.Series, depths: pd.Series) -> pd.Series:
    """The objects and lists within a JSON text, outer ones first."""

    def f(v: str | None, d: int) -> list[dict[str, str]]:
        try:
            return [{"path": p, "content": json.dumps(x)} for p, x in json_values.containers(json.loads(v or ""), int(d))]
        except ValueError:
            return []

    return pd.Series([f(v, d) for v, d in zip(values, depths)], dtype=object)


def schema_parts(resolver: json_schema.Resolver = json_schema.no_network) -> Callable[..., Column]:
    """The sub-schemas of a schema text, expanded."""

    def f(v: str) -> list[dict[str, str]]:
        try:
            return [{"path": p, "content": json.dumps(s)} for p, s in json_schema.sub_schemas(json.loads(v), resolver)]
        except (ValueError, RecursionError, AttributeError):
            return []

    return text_function(f, PARTS)


@F.pandas_udf(struct_of(error_type=STRING, correct=BOOLEAN, schema_ok=BOOLEAN, diff_lines=LONG, chars_added=LONG, chars_missing=LONG, similarity=DOUBLE))
def assess(completion: pd.Series, schema: pd.Series, correct: pd.Series, request_error: pd.Series, synthetic_type: pd.Series) -> pd.DataFrame:
    rows = [scores.assess(*r) for r in zip(completion, schema, correct, request_error, synthetic_type)]
    df = pd.DataFrame(rows, columns=["error_type", "correct", "schema_ok", "diff_lines", "chars_added", "chars_missing", "similarity"], dtype=object)
    return df.astype({"diff_lines": "Int64", "chars_added": "Int64", "chars_missing": "Int64", "similarity": "Float64"})


@F.pandas_udf(STRING)
def as_json(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """A text of a format as JSON; null if it isn't of that format."""
    return pd.Series([json_values.as_json(t, k) for t, k in zip(texts, kinds)], dtype=object)
