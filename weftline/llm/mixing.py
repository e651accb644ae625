"""Mixing sources to target weights with a time-varying curriculum (operator 2).

Every source has a piecewise linear weight schedule over the training time 0..1. Its integral, scaled to the
source's target, is the cumulative demand for its words. A source's documents stand in a fixed random order; the
running sum of their sizes is inverted through the demand, which gives the time at which each is due. Documents
are then range-sorted by that time (training_order, and the query).

The running sums never put a source, nor all rows of one id, into one task: rows go to buckets of the range of a digest
of id and text, each (source, bucket) holds about rows_per_bucket rows however large the source is, and bucket totals
give the offsets.

Cases: a null source is a source of its own, ordered last; null or empty texts have size 0 and are taken with no
words; very long texts are counted whole and may be cut at a target's edge; rows alike in id and text are
interchangeable; no rows give no rows. Extra columns are kept inside the `row` struct, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bucket_of, bucket_offsets, materialise, n_buckets, n_words, order_hash
from weftline.operators.numbering import numbered

#: Multipliers of a source's weight at the times in GRID; sources take these schedules in turn.
GRID = (0.0, 1.0)
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))


def due_time(u: Column, index: Column, grid: tuple = GRID, schedules: tuple = SCHEDULES) -> Column:
    """Time at which the share u (0..1) of a source's demand is reached under schedule `index`."""
    out = F.lit(None).cast("double")
    for k, marks in enumerate(schedules):
        areas = [(grid[j + 1] - grid[j]) * (marks[j] + marks[j + 1]) / 2 for j in range(len(grid) - 1)]
        total, at = sum(areas), F.lit(None).cast("double")
        for j in reversed(range(len(areas))):
            x = u * total - sum(areas[:j])
            slope = (marks[j + 1] - marks[j]) / (grid[j + 1] - grid[j])
            t = F.when(x <= 0, F.lit(grid[j])).otherwise(grid[j] + 2.0 * x / (marks[j] + F.sqrt(F.greatest(marks[j] * marks[j] + 2.0 * slope * x, F.lit(0.0)))))
            at = t if j == len(areas) - 1 else F.when(x < areas[j], t).otherwise(at)
        out = F.when(index == k, at).otherwise(out)
    return out


def fill_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets of the sources (columns total, weight): `share` of all words by weight, none above `most` times its
    total, what is over shared anew by weight among the rest until none is above. The level rises by one
    aggregation a round and no source list reaches the driver."""
    cap, level, seen = F.col("total") * F.lit(most), 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        words, capped, rest, n = sources.agg(F.sum("total"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == seen:
            break
        seen = n
        if rest:
            level = (share * float(words) - float(capped or 0)) / float(rest)
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", grid: tuple = GRID, schedules: tuple = SCHEDULES, rows_per_bucket: int = 8_000, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """One row per row of docs: row (struct of its columns, or of those in carry), size, source_size, target, taken, and copies, an array
    of (words, position), one for every time that the document enters the mix. A document at a target's edge is
    taken with as many of its words as are left."""
    buckets = n_buckets(docs, rows_per_bucket)
    digest = order_hash(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), seed)
    sized = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.concat(F.lit("="), F.col(source_col)).alias("s"), n_words(text_col).alias("size"), digest.alias("digest"), bucket_of(digest, buckets).alias("bucket"))
    sized = sized.withColumn("s", F.coalesce("s", F.lit("")))
    if carry != ("*",):  # narrow rows are written, so that texts are read once
        sized = materialise(sized, "sized")
    stats = materialise(sized.groupBy("s", "bucket").agg(F.any_value("source").alias("source"), F.sum("size").alias("words")), "mix-stats")
    sources = stats.groupBy("s").agg(F.any_value("source").alias("source"), F.sum("words").alias("total"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = fill_targets(materialise(sources.withColumn("weight", weight), "mix-sources"), share, float(most))
    plan = bucket_offsets(stats, ["s"], "bucket", "words", "offset").select("s", "bucket", "offset")
    plan = plan.join(sources.select("s", "rank", F.col("total").alias("source_size"), "target"), "s")
    w = Window.partitionBy("s", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.drop("source").join(plan, ["s", "bucket"]).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("offset"))
    copies = []
    for c in range(most):
        begin = F.col("start") + F.lit(c) * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - begin)).cast("long")
        u = F.when(F.col("target") > 0, begin / F.col("target")).otherwise(0.0)
        free = (F.col("size") == 0) & (begin <= F.col("target")) if c == 0 else F.lit(False)
        copies.append(F.when((words > 0) | free, F.struct(words.alias("words"), due_time(u, F.col("rank") % len(schedules), grid, schedules).alias("position"))))
    placed = placed.withColumn("copies", F.array_compact(F.array(*copies)))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select("row", "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: the columns of the documents, one row per copy, range-sorted by position. Only a document
    at its source's edge is cut, after the last word that is taken; what comes before stays as it is, blanks too."""
    rows = mixed.select("row", "size", F.explode("copies").alias("copy"))
    words = F.regexp_extract_all("row." + text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.col("copy.words").cast("int")), "")
    text = F.when(F.col("copy.words") < F.col("size"), cut).otherwise(F.col("row." + text_col))
    fields = mixed.schema["row"].dataType.fieldNames()
    cols = [(text if c == text_col else F.col("row")[c]).alias(c) for c in fields]
    return rows.repartitionByRange(F.col("copy.position")).sortWithinPartitions("copy.position").select(*cols)
