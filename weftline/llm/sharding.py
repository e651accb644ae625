"""Sharding by a hierarchical weighted hash tree (operator 7).

Regions hold racks, racks hold shards. A row descends level by level: each child of the node that it stands at draws an
exponential time from the row's key and the child's path, divided by the sum of the weights below the child, and the
row goes to the child with the least draw. So a child is met with a probability in proportion to its weight, and a row
takes as many digests as there are children on its way, not as there are shards. A changed weight changes only the
draws of the nodes above it, relative to their siblings: rows move only into or out of the subtrees whose weights
changed. A shard that is added to a tree hangs at its root, as a region of its own, and so takes rows only into itself.

Slots are gapless numbers within a shard in the order of a digest of key and text. They come from bucket counts and a
window over (shard, bucket), so no task holds a whole shard, nor all rows of one key.

Cases: null text counts as empty, a null key is a key of its own, equal keys share a shard; equal texts with other keys
are placed by their keys; rows alike in key and text are interchangeable; very long texts are read whole, for size,
checksum and digest alone; no rows give no rows; extra columns stay in `row`, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bucket_of, bucket_offsets, materialise, n_buckets, order_hash


Leaf = tuple[int, str, float]


def tree(shards: int, regions: int = 2, racks: int = 3, weights: dict[int, float] | None = None, base: int | None = None) -> list[list[list[Leaf]]]:
    """Leaves (shard, path, weight) by region and rack. The first `base` shards (all, if that is None) are dealt round;
    each further one is the only shard of a region of its own."""
    out: list = [[[] for _ in range(racks)] for _ in range(regions)]
    for k in range(shards):
        if base is not None and k >= base:
            region, rack = len(out), 0
            out.append([[]])
        else:
            region, rack = k % regions, k // regions % racks
        out[region][rack].append((k, f"{region}/{rack}/{k}", float((weights or {}).get(k, 1.0))))
    return out


def levels(nodes: list[list[list[Leaf]]]) -> list[list[list[tuple[str, float, int]]]]:
    """By level, the children (path, weight, number) of each node: regions of the root, racks of each region, shards of
    each rack. Regions and racks without shards are left out; the numbers of the last level are the shards."""
    top, middle, last = [], [], []
    for r, region in enumerate(nodes):
        some = [(k, rack) for k, rack in enumerate(region) if rack]
        if not some:
            continue
        top.append((str(r), sum(leaf[2] for _, rack in some for leaf in rack), len(middle)))
        middle.append([(f"{r}/{k}", sum(leaf[2] for leaf in rack), len(last) + i) for i, (k, rack) in enumerate(some)])
        last += [[(path, weight, shard) for shard, path, weight in rack] for _, rack in some]
    return [[top], middle, last]


def draw(key: Column, path: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / 2.0**52) / weight


def descend(key: Column, nodes: list[list[list[Leaf]]]) -> Column:
    """The shard that a row comes to: the child with the least draw, level by level."""
    at = F.lit(0)
    for level in levels(nodes):
        table = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(n).alias("number")) for p, w, n in children]) for children in level])
        children = F.element_at(table, at + 1)
        at = F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["number"].alias("number"))))["number"]
    return at


def assign(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", regions: int = 2, racks: int = 3, weights: dict[int, float] | None = None, rows_per_bucket: int = 8_000, carry: tuple[str, ...] = ("*",)) -> DataFrame:
    """One row per row of docs: row (struct of its columns, or of those in carry), size, text_crc32, law, shard, slot, grown_shard."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    digest = order_hash(F.concat_ws(":", key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), "slot")
    buckets = n_buckets(docs, rows_per_bucket * shards)
    placed = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"), descend(key, tree(shards, regions, racks, weights)).alias("shard"), descend(key, tree(shards + 1, regions, racks, weights, base=shards)).alias("grown_shard"), digest.alias("digest"), bucket_of(digest, buckets).alias("bucket"))
    if carry != ("*",):  # narrow rows are written, so that texts are read once
        placed = materialise(placed, "placed")
    stats = materialise(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-stats")
    offsets = bucket_offsets(stats, ["shard"], "bucket", "n", "offset").drop("n")
    w = Window.partitionBy("shard", "bucket").orderBy("digest", "id", "size", "text_crc32")
    slot = (F.row_number().over(w) - 1 + F.col("offset")).cast("long")
    return placed.join(offsets, ["shard", "bucket"]).select("row", "size", "text_crc32", "law", "shard", slot.alias("slot"), "grown_shard")


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write the rows as Parquet, a folder for each shard."""
    assigned.select("row.*", "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
