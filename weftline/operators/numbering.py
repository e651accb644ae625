"""Row numbers in an order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import materialise


def numbered(df: DataFrame, order: list[Column], out: str, first: int = 0) -> DataFrame:
    """df with numbers from `first` on. The rows are range-sorted and written; each part begins where the counts of
    the parts before end. There are as many counts as partitions, which bounds the broadcast and the window."""
    placed = materialise(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    parts = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", before.alias("__before"))
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(parts), "__part")
    return joined.withColumn(out, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + first).cast("long")).drop("__part", "__before", "__at")
