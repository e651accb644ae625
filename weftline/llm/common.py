"""What the operators of this subpackage share: the shared folder, Arrow word tables, prefix sums by bucket.

Large intermediate results are cut from their lineage by writing them as Parquet to the folder that all
executors share (spark.checkpoint.dir), so that a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.storage import fresh_path, materialise, shared_dir  # noqa: F401

#: Words end at these, for the operators whose words are runs of anything else.
BLANKS = r"[^\x20\x09-\x0D]+"


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow. The session says how large batches of whole texts may be (session.prepare)."""
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `most` bytes of text each (one longer text is a piece of its own)."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(length, dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word codes of all texts one after another, where each text's begin (one more at the end), and the words
    by code. Words are runs without \\x20 and \\x09-\\x0D; a null text has none; lower folds A-Z only."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    starts = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    starts = starts - starts[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        keep = codes != empty
        starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        codes = codes[keep]
    return codes, starts, coded.dictionary


def n_words(text: Column | str) -> Column:
    """Number of runs without \\x20 and \\x09-\\x0D; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANKS)), F.lit(0)).cast("long")


def order_hash(key: Column, seed: str) -> Column:
    """Hex digest that orders rows at random, alike in every run and in any SQL engine with md5."""
    return F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(seed)).cast("binary"))


def n_buckets(df: DataFrame, rows_per_bucket: int) -> int:
    return max(1, -(-df.count() // rows_per_bucket))


def bucket_of(digest: Column, buckets: int) -> Column:
    """Bucket of a hex digest; buckets follow the digests' order, so a running sum can go bucket by bucket."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") * (buckets / 2.0**32)).cast("long")


def bucket_offsets(stats: DataFrame, group: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over the earlier buckets of each group. stats has one row per group and bucket, so a
    window task holds as many rows as there are buckets, never a group's rows."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, most_rows: int, most_bytes: int, seed: str) -> DataFrame:
    """(id, text, the other columns of labels) of at most most_rows labelled documents with at most most_bytes of text,
    written. labels has id, not null, and what is learned.

    First at most most_rows label rows are taken, by a digest of the id; of their documents, which one id may have any
    number of, those with the least digests of id and text, as long as they fit. Only digests and sizes reach the driver.
    Rows alike in id, text and labels count once."""
    few = labels.orderBy(F.xxhash64("id", F.lit(seed)), *labels.columns).limit(most_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    rows = rows.withColumn("__key", F.md5(F.concat_ws(":", F.lit(seed), "id", F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.to_json(F.struct(*[c for c in labels.columns if c != "id"])))))
    known = rows.groupBy("__key").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("size")).orderBy("__key").limit(most_rows)
    chosen, held = [], 0
    for r in known.collect():
        if held + r["size"] <= most_bytes:
            chosen.append((r["__key"],))
            held += r["size"]
    keys = docs.sparkSession.createDataFrame(chosen, "__key string")
    return materialise(rows.join(F.broadcast(keys), "__key").dropDuplicates(["__key"]).drop("__key"), "labelled")


def fold_of(key: object, folds: int) -> int:
    """The fold of an id, so that rows of one id are never both learned from and held out."""
    return zlib.crc32(str(key).encode()) % folds
