"""Running totals over keys of any size, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose totals are summed together.
TOGETHER = 1024


def running_total(df: DataFrame, key: str, order: Column, value: str, bucket: Column, name: str) -> DataFrame:
    """Adds `name`: the total of `value` over the rows of the same `key` that come before.

    The order is by `bucket` (a whole number), then by `order`, which must be total within a bucket.
    Each bucket is summed on its own; the buckets' totals, one row each, are summed in groups of
    `TOGETHER`, and only the groups' totals per key. The joins are sort-merge joins on the buckets:
    what they add grows with the data."""
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key, "_bucket").agg(F.sum(value).alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / TOGETHER))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy(key, "_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select(key, "_group", earlier(Window.partitionBy(key).orderBy("_group")).alias("_groups_before"))
    offsets = totals.select(key, "_bucket", "_group", earlier(Window.partitionBy(key, "_group").orderBy("_bucket")).alias("_offset"))
    offsets = offsets.join(groups.hint("merge"), [key, "_group"]).select(key, "_bucket", (F.col("_offset") + F.col("_groups_before")).alias("_offset"))
    inside = df.withColumn("_before", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return inside.join(offsets.hint("merge"), [key, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_before")).drop("_bucket", "_offset", "_before")
